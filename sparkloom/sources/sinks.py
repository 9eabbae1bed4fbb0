"""Questions to JSON, JSON lines and CSV files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import OutputError
from sparkloom.operators import layouts

Writer = Callable[..., None]
FORMATS: dict[str, Writer] = {}


def register_format(name: str, writer: Writer) -> None:
    """writer(questions, path, layout=…, document=…, statistics=…, **options); the newest of a name counts."""
    FORMATS[name.lower()] = writer


def write(questions: DataFrame, path: str, format: str = "jsonl", layout: str = "default", **options) -> None:
    if format.lower() not in FORMATS:
        raise OutputError(f"no format is called {format!r}; there are {sorted(FORMATS)}")
    FORMATS[format.lower()](questions, path, layout=layout, **options)


def ascii_json(c):
    """JSON text with all but ASCII escaped, as \\uXXXX of its UTF-16 units."""

    def unit(ch):
        units = F.regexp_replace(F.hex(F.encode(ch, "UTF-16BE")), "(....)", r"\\u$1")
        return F.when(F.octet_length(ch) == 1, ch).otherwise(F.lower(units))

    return F.array_join(F.transform(F.split(c, ""), unit), "")


def write_jsonl(questions: DataFrame, path: str, layout: str = "default", ensure_ascii: bool = False, mode: str = "error", document: dict | None = None, statistics: dict | None = None) -> None:
    """One object a line, in as many files as there are partitions; nulls are left out."""
    df = layouts.apply(questions, layout)
    line = F.to_json(F.struct(*df.columns))
    df.select((ascii_json(line) if ensure_ascii else line).alias("value")).write.mode(mode).text(path)


def write_csv(questions: DataFrame, path: str, layout: str = "default", delimiter: str = ",", quote: str = '"', include_document: bool = False, mode: str = "error", document: dict | None = None, statistics: dict | None = None) -> None:
    """Standard columns, metadata's fields and metadata_json; statistics go to <path>_stats.json beside it."""
    flat = layouts.flat(questions, layout, document if include_document else None)
    flat.write.mode(mode).options(header=True, sep=delimiter, quote=quote, escape=quote, emptyValue="").csv(path)
    if statistics:
        _write_text(questions, f"{path.rstrip('/')}_stats.json", json.dumps(statistics, indent=2))


def write_json(questions: DataFrame, path: str, layout: str = "default", key: str | None = None, indent: int | None = 2, ensure_ascii: bool = False, mode: str = "error", document: dict | None = None, statistics: dict | None = None) -> None:
    """One object {document, questions, statistics} for each value of key, or for all rows without a key.

    With a key each object is a line of a text file, made where its rows are: a document's questions fit a row.
    Without one the file is one object by its format, written from a stream of rows.
    """
    if key:
        if key not in questions.columns:
            raise OutputError(f"there is no column {key!r}")
        record = F.struct(*layouts.columns(questions, layout, (key,)))
        out = questions.groupBy(key).agg(F.collect_list(record).alias("questions"))
        line = F.to_json(F.struct(F.struct(F.col(key).alias("id"), *[F.lit(v).alias(k) for k, v in (document or {}).items()]).alias("document"), "questions", F.size("questions").alias("question_count")))
        out.select((ascii_json(line) if ensure_ascii else line).alias("value")).write.mode(mode).text(path)
        return
    records = layouts.apply(questions, layout)
    rows = records.select(F.to_json(F.struct(*records.columns)).alias("value")).toLocalIterator()
    head = json.dumps(document or {}, indent=indent, ensure_ascii=ensure_ascii)
    tail = f', "statistics": {json.dumps(statistics, indent=indent)}' if statistics else ""

    def pieces() -> Iterator[str]:
        yield f'{{"document": {head}, "questions": ['
        for i, r in enumerate(rows):
            yield (", " if i else "") + json.dumps(json.loads(r["value"]), indent=indent, ensure_ascii=ensure_ascii)
        yield f"]{tail}}}"

    _write_text(questions, path, pieces(), mode)


def _write_text(df: DataFrame, path: str, text: str | Iterable[str], mode: str = "overwrite") -> None:
    """One file, as its pieces come, through the cluster's file system, put in its place by a rename."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and mode != "overwrite":
        raise OutputError(f"{path} exists")
    out = fs.create(temp, True)
    held, size = [], 0
    for piece in [text] if isinstance(text, str) else text:
        held.append(piece)
        size += len(piece)
        if size > 1 << 20:
            out.write(bytearray("".join(held).encode()))
            held, size = [], 0
    out.write(bytearray("".join(held).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OutputError(f"{path} can't be written")


for _name, _writer in (("jsonl", write_jsonl), ("csv", write_csv), ("json", write_json)):
    register_format(_name, _writer)
