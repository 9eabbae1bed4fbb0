"""Markdown: front matter and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import sections as S

_FENCE = r"(?s)\A(---|\+\+\+)[ \t]*\n(.*?)\n\1[ \t]*(?:\n|\z)"


def strip_front_matter(c: Column | str) -> Column:
    return F.regexp_replace(T._col(c), _FENCE, "")


def front_matter(c: Column | str) -> Column:
    """A map of the head's 'key: value' (or 'key = value') lines: keys lower-case, quotes gone; empty without a head."""
    head = F.regexp_extract(T._col(c), _FENCE, 2)
    rows = F.transform(T.lines(head), lambda l: F.struct(F.lower(T.strip(F.regexp_extract(l, r"^([^:=]+)[:=]", 1))).alias("key"), T.strip(F.regexp_replace(T.strip(F.regexp_extract(l, r"^[^:=]+[:=](.*)", 1)), r"^[\"']|[\"']\z", "")).alias("value")))
    named = F.filter(rows, lambda r: (r["key"] != "") & ~r["key"].startswith("#"))
    first = F.filter(named, lambda r, i: ~F.exists(F.slice(named, F.lit(1), i), lambda b: b["key"] == r["key"]))
    return F.map_from_entries(F.transform(first, lambda r: F.struct(r["key"], F.nullif(r["value"], F.lit("")))))


def sections(c: Column | str) -> Column:
    """Headings by '#' marks and the paragraphs between them, front matter left out."""
    return S.extract(strip_front_matter(c), markdown_only=True)


_CODE = r"(?sm)^ {0,3}(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\z)"
_MARK = "\x01"


def structure(c: Column | str) -> Column:
    """Sections by the marks of Markdown: headings (# or underlined), paragraphs, list items and quotes, and fenced code.

    A fence's lines are one code_block as they stand, so that a comment in it is no heading; an open fence goes to the
    end. Each list item and each quote is a paragraph without its marks. Lines of a paragraph are joined by a space.
    """

    def outside(t: Column) -> Column:
        for pattern, new in (
            (r"(?m)^ {0,3}([^\s#>].*)\n {0,3}=+[ \t]*$", "# $1"),
            (r"(?m)^ {0,3}([^\s#>*+-].*)\n {0,3}-{2,}[ \t]*$", "## $1"),
            (r"(?m)^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", ""),
            (r"(?m)^(?![ \t]*>)(.+)\n(?=[ \t]*>)", "$1\n\n"),
            (r"(?m)^(?:[ \t]*>)+[ \t]?", ""),
            (r"(?m)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)", "\n"),
            (r"(?m)^(#{1,6}[ \t].*?)[ \t]+#+[ \t]*$", "$1"),
        ):
            t = F.regexp_replace(t, pattern, new)
        return S.extract(t, markdown_only=True, joint=" ")

    def part(t: Column) -> Column:
        code = F.array(S._section(F.regexp_replace(F.regexp_extract(t, _CODE, 3), r"\n\z", ""), "code_block", 0))
        return F.when(t.rlike(r"\A {0,3}(?:`{3}|~{3})"), code).otherwise(outside(t))

    def whole(t: Column) -> Column:
        parts = F.split(F.regexp_replace(F.translate(t, _MARK, ""), _CODE, f"{_MARK}$0{_MARK}"), _MARK)
        return F.flatten(F.transform(parts, part))

    return T.let(strip_front_matter(c), whole)
