"""Pages as tables of text blocks: (doc_id, page, block, x0, x1, y0, size, bold, text, page_width, page_height).

What a page reader extracts goes through these; none of them needs a reader to be installed.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

PAGE = ("doc_id", "page")


def body_font(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, body_size): the most frequent size, the one seen first among equals."""
    counted = blocks.groupBy(*PAGE, "size").agg(F.count("*").alias("n"), F.min("block").alias("first"))
    best = F.max_by("size", F.struct(F.col("n"), -F.col("first")))
    return counted.groupBy(*PAGE).agg(best.alias("body_size"))


def _kinds(blocks: DataFrame, ratio: float, number: bool) -> DataFrame:
    body = F.coalesce(F.col("body_size"), F.lit(10.0))
    head = (F.col("size") > body * ratio) | F.col("bold")
    top = (F.col("y0") < F.col("page_height") * 0.2) & (F.col("size") > body * 1.5)
    text = F.concat("text", F.lit(" [Page "), (F.col("page") + 1).cast("string"), F.lit("]")) if number else F.col("text")
    return blocks.withColumns({
        "section_type": F.when(head & top, "title").when(head, "heading").otherwise("paragraph"),
        "level": F.when(~head, 0).when(head & top, 1).when(F.col("size") < body * 1.5, 2).otherwise(1),
        "content": F.when(head, text).otherwise(F.col("text")),
    })


def _with_body(blocks: DataFrame) -> DataFrame:
    """body_size beside each block: the same partitioning serves counting and ordering, so there's one shuffle."""
    w, page = Window.partitionBy(*PAGE, "size"), Window.partitionBy(*PAGE)
    df = blocks.withColumn("__n", F.count("*").over(w)).withColumn("__f", F.min("block").over(w))
    return df.withColumn("body_size", F.max_by("size", F.struct(F.col("__n"), -F.col("__f"))).over(page)).drop("__n", "__f")


def reading_order(blocks: DataFrame, ratio: float = 1.2, number: bool = True) -> DataFrame:
    """Blocks by height on the page, with pos, section_type, level and content: large or bold blocks are headings."""
    df = _with_body(blocks.repartition(*PAGE)).withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "block")) - 1)
    return _kinds(df, ratio, number)


def _bin(bins: int = 10) -> Column:
    return F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / (F.col("page_width") / bins)), F.lit(bins - 1)).cast("int")


def column_count(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, n_columns): one more than the peaks of a ten-part histogram of block centres; 1 without a peak or with under three blocks."""
    binned = blocks.withColumn("__bin", _bin())
    counts = [F.count(F.when(F.col("__bin") == i, 1)) for i in range(10)]
    page = binned.groupBy(*PAGE).agg(F.array(*counts).alias("h"), F.count("*").alias("n"))
    peaks = F.size(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.get("h", i) > F.get("h", i - 1)) & (F.get("h", i) > F.get("h", i + 1))))
    return page.select(*PAGE, F.when((F.col("n") < 3) | (peaks == 0), 1).otherwise(peaks + 1).cast("int").alias("n_columns"))


def column_order(blocks: DataFrame, ratio: float = 1.2, number: bool = True) -> DataFrame:
    """Blocks column by column from the left, each by height; else as reading_order."""
    df = _with_body(blocks.repartition(*PAGE))
    page = Window.partitionBy(*PAGE)
    df = df.withColumn("__bin", _bin())
    for i in range(10):
        df = df.withColumn(f"__h{i}", F.count(F.when(F.col("__bin") == i, 1)).over(page))
    peaks = sum(((F.col(f"__h{i}") > F.col(f"__h{i - 1}")) & (F.col(f"__h{i}") > F.col(f"__h{i + 1}"))).cast("int") for i in range(1, 9))
    df = df.withColumn("n_columns", F.when((F.count("*").over(page) < 3) | (peaks == 0), 1).otherwise(peaks + 1))
    centre = (F.col("x0") + F.col("x1")) / 2
    df = df.withColumn("column", F.least(F.floor(centre / (F.col("page_width") / F.col("n_columns"))).cast("int"), F.col("n_columns") - 1))
    df = df.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "y0", "block")) - 1)
    return _kinds(df, ratio, number).drop("__bin", *[f"__h{i}" for i in range(10)])


def repeated_lines(blocks: DataFrame, threshold: float = 0.75, pages: int = 3, longest: int = 200) -> DataFrame:
    """(doc_id, place, text, pages): first or last blocks of pages that are alike on at least three pages.

    A block joins the first group, in page order, whose first text it is alike; so each document is a fold. Only the
    outermost blocks are gathered, two for each page.
    """
    ends = blocks.groupBy(*PAGE).agg(F.min_by("text", F.struct("y0", "block")).alias("header"), F.max_by("text", F.struct("y0", "block")).alias("footer"))
    rows = ends.select("doc_id", "page", F.stack(F.lit(2), F.lit("header"), F.col("header"), F.lit("footer"), F.col("footer")).alias("place", "text"))
    rows = rows.where((F.col("text") != "") & (F.char_length("text") < longest))
    listed = rows.groupBy("doc_id", "place").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("found"))

    @F.pandas_udf("array<struct<text:string,pages:int>>")
    def groups(found: pd.Series) -> pd.Series:
        out = []
        for row in found:
            seen: dict[str, int] = {}
            for x in row:
                at = next((k for k in seen if k == x["text"] or SequenceMatcher(None, x["text"], k).ratio() > threshold), x["text"])
                seen[at] = seen.get(at, 0) + 1
            out.append([{"text": k, "pages": n} for k, n in seen.items() if n >= pages])
        return pd.Series(out)

    return T.each(listed.where(F.size("found") >= pages), ["doc_id", "place"], groups("found")).select("doc_id", "place", "x.text", "x.pages")


def drop_repeated(blocks: DataFrame, repeated: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Blocks without those alike one of their document's repeated lines."""

    @F.pandas_udf("boolean")
    def alike(text: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([k is not None and any(SequenceMatcher(None, t or "", x).ratio() > threshold for x in k) for t, k in zip(text, known)])

    lists = repeated.groupBy("doc_id").agg(F.collect_set("text").alias("__known"))
    return blocks.join(lists, "doc_id", "left").where(F.col("__known").isNull() | ~alike("text", "__known")).drop("__known")


def needs_ocr(images: Column | str, text_len: Column | str, area: Column | str) -> Column:
    """A page with images and hardly any text of its own."""
    images, text_len, area = map(T._col, (images, text_len, area))
    return (images > 0) & ((text_len < 50) | (text_len / area < 0.0005))


def clean_ocr(c: Column | str) -> Column:
    """Without lines of three characters or fewer; frequent misreadings mended."""
    long = F.filter(T.lines(T._col(c)), lambda l: F.char_length(T.strip(l)) > 3)
    mended = F.translate(F.array_join(long, "\n"), "|¢—–", "Ic--")
    return F.when(T._col(c) == "", "").otherwise(F.regexp_replace(mended, r"([\p{L}\p{N}_])\.([\p{L}\p{N}_])", "$1$2"))


def join_pages(pages: Column | str) -> Column:
    """An array of page texts, sentences that go on over a page's end put together.

    A page is carried over if it has no sentence end in its last 20 characters or ends with '-'; the next page
    is put to it if that begins lower-case or with closing punctuation.
    """
    empty = F.expr("cast(array() as array<string>)")

    def step(s: Column, page: Column) -> Column:
        head = F.regexp_replace(page, rf"^{T.WS}+", "")
        goes_on = s["held"].isNotNull() & head.rlike(r"^(?:\p{Ll}|[,;:)\]}>])")
        text = F.when(goes_on, F.concat(s["held"], F.lit(" "), head)).otherwise(page)
        done = F.when(s["held"].isNotNull() & ~goes_on, F.array_append(s["out"], s["held"])).otherwise(s["out"])
        open_ = ~F.right(text, F.lit(20)).rlike(r"[.!?]") | text.rlike(rf"-{T.WS}*\z")
        new = F.struct(F.when(open_, text).alias("held"), F.when(open_, done).otherwise(F.array_append(done, text)).alias("out"))
        return F.when(T.strip(page) == "", s).otherwise(new)

    start = F.struct(F.lit(None).cast("string").alias("held"), empty.alias("out"))
    return F.aggregate(T._col(pages), start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"])))


def documents(blocks: DataFrame, ratio: float = 1.2, number: bool = True, threshold: float = 0.75) -> DataFrame:
    """(doc_id, text, sections) of block tables, by all page passes in their order.

    Heads and feet that repeat are dropped; recognised text (column ocr, if there is one) is mended; each page's blocks go
    column by column; sentences that go on over a page's end are put together in the text, while sections keep
    the blocks as they are. Without a kept block a document has no row.
    """
    kept = drop_repeated(blocks, repeated_lines(blocks, threshold), threshold)
    if "ocr" in blocks.columns:
        kept = kept.withColumn("text", F.when(F.coalesce("ocr", F.lit(False)), clean_ocr("text")).otherwise(F.col("text"))).where("text <> ''")
    ordered = column_order(kept, ratio, number)
    section = F.struct("content", "section_type", F.col("level").cast("int").alias("level"))
    listed = ordered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "text", section.alias("section")))).alias("b"))

    def texts(b: Column) -> Column:
        numbers = F.array_distinct(F.transform(b, lambda x: x["page"]))
        return F.transform(numbers, lambda p: F.array_join(F.transform(F.filter(b, lambda x: x["page"] == p), lambda x: x["text"]), "\n"))

    return listed.select("doc_id", F.array_join(join_pages(texts(F.col("b"))), "\n\n").alias("text"), F.transform("b", lambda x: x["section"]).alias("sections"))
