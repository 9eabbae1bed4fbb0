"""Layouts of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import OutputError
from sparkloom.functions import text as T

LAYOUTS = ("default", "openai_chat", "openai_legacy", "standard")
#: Names of the question's and the answer's column in CSV files.
CSV_NAMES = {"default": ("question", "answer"), "openai_chat": ("question", "answer"), "openai_legacy": ("prompt", "completion"), "standard": ("input", "output")}


def _text(df: DataFrame) -> Column:
    return F.col("text") if "text" in df.columns else F.col("question")


def messages(question: Column | str, answer: Column | str) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), T._col(c).alias("content"))
    return F.array(turn("user", question), turn("assistant", answer))


def columns(df: DataFrame, layout: str = "default", leave_out: tuple[str, ...] = ()) -> list[Column]:
    """A record's columns, in order; those left out don't get into it."""
    names = [c for c in df.columns if c not in leave_out]
    kept = [F.col(c) for c in ("context", "metadata") if c in names]
    if layout == "openai_chat":
        return [messages(_text(df), "answer").alias("messages"), *kept]
    if layout == "openai_legacy":
        return [_text(df).alias("prompt"), F.col("answer").alias("completion"), *kept]
    if layout == "standard":
        return [_text(df).alias("input"), F.col("answer").alias("output"), *[F.col(c) for c in names if c not in ("text", "question", "answer")]]
    if layout == "default":
        return [F.col(c).alias("question") if c == "text" else F.col(c) for c in names if not (c == "question" and "text" in names)]
    raise OutputError(f"no layout is called {layout!r}; there are {LAYOUTS}")


def apply(df: DataFrame, layout: str = "default") -> DataFrame:
    """Questions (text or question, answer, context, metadata and others) as records of a layout."""
    return df.select(*columns(df, layout))


def flat(df: DataFrame, layout: str = "default", document: dict[str, str] | None = None) -> DataFrame:
    """Columns for CSV: six standard ones, the scalar fields of metadata's structs, metadata_json, and the document's."""
    if layout not in LAYOUTS:
        raise OutputError(f"no layout is called {layout!r}; there are {LAYOUTS}")
    q, a = CSV_NAMES[layout]
    blank = F.lit("")
    standard = [F.col("id") if "id" in df.columns else blank.alias("id"), _text(df).alias(q), F.col("answer").alias(a), *[F.col(c) if c in df.columns else blank.alias(c) for c in ("context", "category", "chunk_id")]]
    more: list[Column] = []
    kind = df.schema["metadata"].dataType if "metadata" in df.columns else None
    if kind is not None and kind.typeName() == "struct":
        for f in kind.fields:
            at = F.col(f"metadata.{f.name}")
            if f.dataType.typeName() == "struct":
                label = "position" if f.name == "position_info" else f.name
                more += [at[g.name].cast("string").alias(f"{label}_{g.name}") for g in f.dataType.fields if g.dataType.typeName() not in ("struct", "array", "map")]
            elif f.dataType.typeName() == "array":
                more.append(F.array_join(at.cast("array<string>"), ", ").alias(f.name))
            elif f.dataType.typeName() != "map":
                more.append(at.cast("string").alias(f.name))
    as_json = F.to_json("metadata").alias("metadata_json") if kind is not None else blank.alias("metadata_json")
    return df.select(*standard, *more, as_json, *[F.lit(v or "").alias(f"document_{k}") for k, v in (document or {}).items()])
