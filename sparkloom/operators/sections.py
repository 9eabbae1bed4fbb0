"""Sections of a document: headings and paragraphs in order, as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

SECTIONS = "array<struct<content:string,section_type:string,level:int>>"
MAX_HEADING = 150

_NUMBERED = r"(?i)^(chapter|section|part|appendix)\s+([ivxlcdm\d.:]+)([:.\s].*)?\z"


def _section(content: Column, kind: str, level: Column | int) -> Column:
    return F.struct(content.alias("content"), F.lit(kind).alias("section_type"), (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"))


def classify(line: Column, markdown_only: bool = False) -> Column:
    """Struct (content, level) if a stripped line is a heading, else null; the first rule that holds decides."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+", 1)
    out = F.when(marks != "", F.struct(T.strip(F.regexp_extract(line, r"^#{1,6}\s+(.*)", 1)).alias("content"), F.char_length(marks).alias("level")))
    if markdown_only:
        return out
    parts = F.filter(F.array(*[F.regexp_extract(line, _NUMBERED, g) for g in (1, 2, 3)]), lambda p: p != "")
    name = F.regexp_extract(line, _NUMBERED, 1)
    out = out.when(line.rlike(_NUMBERED), F.struct(T.strip(F.array_join(parts, " ")).alias("content"), F.when(name == "Chapter", 1).otherwise(2).alias("level")))
    out = out.when(line.rlike(r"^[A-Z][A-Za-z\s]*\z") & (F.char_length(line) < MAX_HEADING), F.struct(line.alias("content"), F.lit(2).alias("level")))
    return out.when(line.rlike(r"^[A-Z\s\d]+\z"), F.struct(line.alias("content"), F.lit(1).alias("level")))


def _long_letters(line: Column) -> Column:
    """A long letters-only line: no heading, but it ends the paragraph before it."""
    return line.rlike(r"^[A-Z][A-Za-z\s]*\z") & (F.char_length(line) >= MAX_HEADING)


def extract(c: Column | str, markdown_only: bool = False, joint: str | None = None) -> Column:
    """A text's sections by heading rules: other lines join to paragraphs that blank lines and headings end.

    Lines are classified once; a section begins at a heading or where a paragraph opens, and is sliced from the
    lines up to the next beginning.
    """
    joint = joint if joint is not None else "\n" if markdown_only else " "
    empty = F.expr(f"cast(array() as {SECTIONS})")

    def line(x: Column) -> Column:
        return F.struct(x.alias("text"), classify(x, markdown_only).alias("head"), F.lit(False).alias("breaks") if markdown_only else _long_letters(x).alias("breaks"))

    def mark(p: Column, i: Column) -> Column:
        now, before = p["now"], p["before"]
        body = (now["text"] != "") & now["head"].isNull()
        opens = before.isNull() | (before["text"] == "") | before["head"].isNotNull() | now["breaks"]
        return F.struct(i.alias("i"), now["head"].alias("head"), (now["head"].isNotNull() | (body & opens)).alias("begins"))

    def starts(rows: Column) -> Column:
        before = F.concat(F.array(F.lit(None)), F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))))
        return F.filter(F.transform(F.arrays_zip(rows.alias("now"), before.alias("before")), mark), lambda m: m["begins"])

    def cut(rows: Column, marks: Column) -> Column:
        ends = F.concat(F.transform(F.slice(marks, F.lit(2), F.size(marks)), lambda m: m["i"]), F.array(F.size(rows)))

        def build(z: Column) -> Column:
            head, i = z["m"]["head"], z["m"]["i"]
            own = F.filter(F.transform(F.slice(rows, i + 1, z["e"] - i), lambda r: r["text"]), lambda x: x != "")
            return F.when(head.isNotNull(), _section(head["content"], "heading", F.greatest(F.lit(1), head["level"]))).otherwise(_section(F.array_join(own, joint), "paragraph", 0))

        return F.transform(F.arrays_zip(marks.alias("m"), ends.alias("e")), build)

    def whole(t: Column) -> Column:
        found = T.let(F.transform(F.transform(T.lines(t), T.strip_part), line), lambda rows: T.let(starts(rows), lambda marks: F.when(F.size(marks) == 0, empty).otherwise(cut(rows, marks))))
        return F.when(F.coalesce(T.strip(t), F.lit("")) == "", empty).otherwise(found)

    return T.let(T._col(c), whole)


def resolve(loader_sections: Column | str | None, c: Column | str) -> Column:
    """The loader's sections, else the heuristic ones, else the whole text as one paragraph."""
    def or_whole(t: Column) -> Column:
        return T.let(extract(t), lambda x: F.when((F.size(x) > 0) | (F.coalesce(T.strip(t), F.lit("")) == ""), x).otherwise(F.array(_section(T.strip(t), "paragraph", 0))))

    found = T.let(T._col(c), or_whole)
    if loader_sections is None:
        return found
    own = F.col(loader_sections) if isinstance(loader_sections, str) else loader_sections
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(found)


def heading_path(sections: Column) -> Column:
    """Contents of the headings in force after all sections: a heading drops those of its level and deeper."""
    heads = F.filter(sections, lambda s: s["section_type"].isin("heading", "title"))
    kind = "cast(array() as array<struct<content:string,level:int>>)"
    stack = F.aggregate(heads, F.expr(kind), lambda a, h: F.array_append(F.filter(a, lambda x: x["level"] < h["level"]), F.struct(h["content"].alias("content"), h["level"].alias("level"))))
    return F.transform(stack, lambda x: x["content"])


def explode(docs: DataFrame, key: str = "doc_id", sections: str = "sections") -> DataFrame:
    """(key, pos, content, section_type, level)."""
    return T.each(docs, [key], sections, "s").select(key, "pos", "s.*")
