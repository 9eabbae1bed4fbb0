"""Files to documents: text, Markdown, DOCX and PDF, each kind by its reader, and what can't be read as rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.sections import SECTIONS
from sparkloom.sources import docx, markdown, pages, pdf

TEXT = ("txt", "text", "log", "yaml", "yml", "ini", "cfg", "conf", "json", "csv", "tsv", "")
MARKDOWN = ("md", "markdown")
COLUMNS = ("doc_id", "path", "doc_type", "title", "author", "date", "language", "text", "sections", "custom", "error")

Reader = Callable[[DataFrame], DataFrame]


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(T.basename(path), r"\.([^.]+)\z", 1))


#: Kinds by media type.
MIME = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/markdown": "markdown", "text/x-markdown": "markdown", "text/plain": "text", "text/csv": "text", "application/json": "text"}


def doc_type(path: Column | str, content: Column | str, mime: Column | str | None = None) -> Column:
    """By extension, the particular kinds first; else by media type, if there is a column of it; else by the first bytes; else text if they are valid UTF-8; else unknown."""
    ext, head = extension(path), F.substring(T._col(content), 1, 1024)
    out = F.when(ext.isin(*MARKDOWN), "markdown").when(ext == "docx", "docx").when(ext == "pdf", "pdf")
    for kind, own in EXTENSIONS.items():
        out = out.when(ext.isin(*own), kind)
    out = out.when(ext.isin(*[x for x in TEXT if x]), "text")
    if mime is not None:
        kind = F.lower(T.strip(F.regexp_extract(T._col(mime), r"^([^;]*)", 1)))
        for name, own in MIME.items():
            out = out.when(kind == name, own)
    out = out.when(ext == "", "text") if mime is None else out
    out = out.when(F.hex(F.substring(head, 1, 5)) == "255044462D", "pdf").when(F.hex(F.substring(head, 1, 4)) == "504B0304", "docx")
    # the last three bytes may be a cut character
    whole = F.is_valid_utf8(head) | F.is_valid_utf8(F.substring(head, 1, 1023)) | F.is_valid_utf8(F.substring(head, 1, 1022)) | F.is_valid_utf8(F.substring(head, 1, 1021))
    return out.when((F.octet_length(head) > 0) & whole & ~F.hex(head).rlike("^(?:..)*?00"), "text").otherwise("unknown")


def stem(path: Column | str) -> Column:
    return F.regexp_replace(T.basename(path), r"(.)\.[^.]*\z", "$1")


def _row(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    base = {"doc_id": F.sha2("path", 256), "path": F.col("path"), "doc_type": F.lit(kind), "title": stem("path"), "author": F.lit(None), "date": F.lit(None), "language": F.lit(None), "text": F.lit(None), "sections": F.lit(None).cast(SECTIONS), "custom": F.lit(None).cast("map<string,string>"), "error": F.lit(None)}
    kinds = {"sections": SECTIONS, "custom": "map<string,string>"}
    return df.select(*[(base | cols)[c].cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def read_text(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """Whole files as text; the name without extension is the title. Wrong bytes are an error."""
    if encoding.lower().replace("-", "") == "utf8":
        ok, text = F.is_valid_utf8("content"), F.col("content").cast("string")
    else:
        ok, text = F.lit(True), F.decode("content", encoding)
    return _row(files, "text", text=F.when(ok, text), error=F.when(~ok, f"the file isn't {encoding}"))


def read_markdown(files: DataFrame) -> DataFrame:
    """Front matter to metadata, headings and paragraphs to sections."""
    ok, raw = F.is_valid_utf8("content"), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    df = files.withColumns({"__raw": F.when(ok, raw)}).withColumns({"__meta": markdown.front_matter("__raw"), "__body": markdown.strip_front_matter("__raw")})
    known = ("title", "author", "date", "language")
    own = {k: F.col("__meta")[k] for k in known}
    own["title"] = F.coalesce(own["title"], stem("path"))
    return _row(df, "markdown", text=F.col("__body"), sections=markdown.structure("__body"), custom=F.map_filter("__meta", lambda k, v: ~k.isin(*known)), error=F.when(~ok, "the file isn't utf-8"), **own)


def read_pdf(files: DataFrame) -> DataFrame:
    """Files parsed once into a written table; their blocks go through the page operators."""
    from sparkloom.session import materialize

    parsed = materialize(files.select("path", pdf.parse("content").alias("d")), "pdf")
    body = pages.documents(pdf.blocks(parsed)).withColumnRenamed("doc_id", "path")
    meta = {k: F.col(f"d.{k}") for k in ("author", "date", "custom", "error")}
    return _row(parsed.join(body, "path", "left"), "pdf", title=F.coalesce("d.title", stem("path")), text=F.col("text"), sections=F.col("sections"), **meta)


READERS: dict[str, Reader] = {"text": read_text, "markdown": read_markdown, "docx": lambda df: _row(df.withColumn("d", docx.parse("path", "content")), "docx", **docx.columns("d")), "pdf": read_pdf}
EXTENSIONS: dict[str, tuple[str, ...]] = {}


def register_reader(kind: str, extensions: tuple[str, ...], reader: Reader) -> None:
    """A reader of another kind of file: from (path, content) to COLUMNS. Its extensions win over the text reader's."""
    READERS[kind], EXTENSIONS[kind] = reader, tuple(e.lower().lstrip(".") for e in extensions)


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content) of a file's, folder's or pattern's files; files without a byte are left out by the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def parse(found: DataFrame, enabled: tuple[str, ...] = ()) -> DataFrame:
    """Files by kind to documents with an error where one can't be used. One scan for each kind that is enabled (all by default)."""
    kinds = enabled or tuple(READERS)
    typed = found.withColumn("kind", doc_type("path", "content"))
    out = _row(typed.where(~F.col("kind").isin(*kinds)), "unknown", error=F.lit("no reader takes this file"))
    for k in kinds:
        out = out.unionByName(READERS[k](typed.where(F.col("kind") == k).drop("kind")).select(*COLUMNS))
    empty = F.col("error").isNull() & (F.coalesce(T.strip("text"), F.lit("")) == "")
    return out.withColumn("error", F.when(empty, "the document is empty").otherwise(F.col("error")))


def read(spark: SparkSession, path: str, recursive: bool = False, enabled: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): rejects have path and error."""
    from sparkloom.session import materialize

    docs = materialize(parse(files(spark, path, recursive), enabled), "documents")
    return docs.where("error is null").drop("error"), docs.where("error is not null").select("path", "doc_type", "error")
