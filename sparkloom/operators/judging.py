"""Verdicts on questions: thresholds on judged dimensions, leaks, near duplicates, and all of them together."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import likeness as likenesses

FAITHFULNESS = ("factual_accuracy", "answer_completeness")
STANDALONE = ("standalone",)
DIMENSIONS = FAITHFULNESS + STANDALONE
THRESHOLD = 0.7

#: Further validators by name: (columns of the question) to a boolean Column.
VALIDATORS: dict[str, Callable[[DataFrame], Column]] = {}


def register_validator(name: str, valid: Callable[[DataFrame], Column]) -> None:
    VALIDATORS[name] = valid


def passes(score: Column | str, threshold: float = THRESHOLD) -> Column:
    """Whether a judged score reaches its threshold; a missing score is 0."""
    return F.coalesce(T._col(score), F.lit(0.0)) >= threshold


def reason(dimension: str, score: Column | str, threshold: float = THRESHOLD, said: Column | str | None = None) -> Column:
    """'(dimension) dimension score: x.xx (Threshold: t)', then what the judge said."""
    base = F.format_string(f"({dimension}) {dimension} score: %.2f (Threshold: {threshold})", F.coalesce(T._col(score), F.lit(0.0)))
    return base if said is None else F.concat_ws(" - ", base, T._col(said))


def merge_judges(faithful: DataFrame, standalone: DataFrame, key: str = "question_id") -> DataFrame:
    """Both judges' scores beside each other; a dimension whose judge failed scores 0; faithfulness' suggestion wins.

    Questions that neither judge answered have no row.
    """
    a = faithful.withColumnRenamed("suggestion", "__first") if "suggestion" in faithful.columns else faithful.withColumn("__first", F.lit(None).cast("string"))
    b = standalone.withColumnRenamed("suggestion", "__second") if "suggestion" in standalone.columns else standalone.withColumn("__second", F.lit(None).cast("string"))
    scores = [F.coalesce(d, F.lit(0.0)).alias(d) for d in DIMENSIONS]
    return a.join(b, key, "full_outer").select(key, *scores, F.coalesce("__first", "__second").alias("suggestion"))


def judged(faithful: Column, standalone: Column) -> dict[str, Column]:
    """merge_judges() of the structs of both judges' replies in one row; without any reply the scores are null."""
    answered = faithful.isNotNull() | standalone.isNotNull()
    scores = {d: F.when(answered, F.coalesce(j[d], F.lit(0.0))) for j, ds in ((faithful, FAITHFULNESS), (standalone, STANDALONE)) for d in ds}
    return scores | {"suggestion": F.coalesce(faithful["suggestion"], standalone["suggestion"])}


def verdicts(df: DataFrame, thresholds: dict[str, float] | None = None, leak: str | None = "leak_action", extra: bool = True) -> DataFrame:
    """Adds <dimension>_ok, is_valid and reasons.

    Dropped questions were not judged: they are invalid for that. The others need every dimension, and every
    registered validator, to pass; without any check a question is invalid.
    """
    limits = thresholds if thresholds is not None else {d: THRESHOLD for d in DIMENSIONS}
    dropped = F.col(leak) == "drop" if leak else F.lit(False)
    own = {f"{d}_ok": ~dropped & passes(d, t) for d, t in limits.items()}
    own |= {f"{n}_ok": F.coalesce(f(df), F.lit(False)) for n, f in VALIDATORS.items()} if extra else {}
    df = df.withColumns(own) if own else df
    all_ok = F.lit(bool(own))
    for c in own:
        all_ok = all_ok & F.col(c)
    said = [F.when(~dropped, reason(d, d, t)) for d, t in limits.items()]
    said.append(F.when(dropped, "(leak_filter) refers to its source").when(F.col(leak) == "flag", "(leak_filter) may refer to its source") if leak else F.lit(None).cast("string"))
    return df.withColumns({"is_valid": all_ok & ~dropped, "reasons": F.array_compact(F.array(*said))})


def likeness(threshold: float):
    """A function of arrays of normal forms: the greatest likeness of each to an accepted one before it."""

    @F.pandas_udf("array<double>")
    def greatest(lists: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else likenesses.greatest(row, threshold) for row in lists], dtype=object)

    return greatest


def diversity(questions: DataFrame, group: str = "chunk_id", order: str = "generation_index", text: str = "question", threshold: float = 0.85) -> DataFrame:
    """Adds diversity (1 less the greatest likeness to an accepted question before it) and diversity_ok (likeness under the threshold).

    Within a group, in order; accepted are those that passed here, whatever other checks say. Groups are
    chunks, of at most a few dozen questions: their rows are gathered into arrays, with one shuffle, and each batch of
    groups crosses to Python once.
    """
    packed = questions.withColumn("__norm", T.diversity_form(F.coalesce(F.col(text), F.lit(""))))
    # a number of partitions of its own: small in bytes, costly in comparisons, so adaptive merging would be wrong
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.repartition(parts, group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), F.col("__norm"), F.struct(*questions.columns).alias("row")))).alias("rows"))

    scored = rows.withColumn("__best", likeness(threshold)(F.transform("rows", lambda r: r["__norm"])))
    return T.each(scored, [], F.arrays_zip("rows", "__best"), "z").select("z.rows.row.*", (1 - F.col("z.__best")).alias("diversity"), (F.col("z.__best") < threshold).alias("diversity_ok"))


def distinct_questions(questions: DataFrame, group: str = "chunk_id", order: str = "generation_index", text: str = "question") -> DataFrame:
    """The first of each group's questions with the same normal form: near duplicates at a threshold of 1, without Python."""
    first = F.row_number().over(_window(group, "__norm", order))
    return questions.withColumn("__norm", T.diversity_form(F.coalesce(F.col(text), F.lit("")))).withColumn("__n", first).where("__n = 1").drop("__n", "__norm")


def _window(group: str, norm: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group, norm).orderBy(order)
