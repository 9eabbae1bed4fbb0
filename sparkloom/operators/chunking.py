"""Chunks of documents: two folds over an array of sections, overlaps, merging of small chunks, and context.

The folds depend on order and state, so they run in Arrow batches over one row's array: a document is one row,
nothing is shuffled, and the chunks are exploded afterwards. All else are Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sparkloom.errors import ChunkingError
from sparkloom.functions import text as T
from sparkloom.session import give_back

HEADINGS = "array<struct<content:string,level:int>>"


@dataclass(frozen=True)
class Chunking:
    """strategy: 'semantic', 'fixed_size' or a registered name; sizes are characters.

    own_heading: a chunk that ends where a heading begins keeps the headings it was under (else, that heading's
    predecessors of the same level are missing from its context). split_long: the fixed strategy cuts
    sections beyond the target, which it otherwise keeps whole.
    """

    strategy: str = "semantic"
    target: int = 1500
    overlap: int = 150
    min: int = 500
    max: int = 2500
    preserve_headings: bool = True
    own_heading: bool = True
    split_long: bool = False

    def __post_init__(self):
        if not 0 <= self.min <= self.target <= self.max or self.target < 1 or self.overlap < 0:
            raise ChunkingError(f"sizes must follow 0 <= min ({self.min}) <= target ({self.target}) <= max ({self.max})")


def _push(stack: list[dict], s: dict) -> list[dict]:
    return [h for h in stack if h["level"] < s["level"]] + [{"content": s["content"], "level": s["level"]}]


def _fixed_tail(text: str, n: int) -> str:
    if len(text) <= n:
        return text
    tail = text[-n:] if n else ""
    ends = list(re.finditer(r"[.!?]\s", tail))
    if ends:
        return tail[ends[-1].end() :]
    found = tail.split()
    return " ".join(found[-3:]) if found else text[-min(100, n) :] if n else ""


def _semantic_tail(text: str, n: int) -> str:
    if not text or n <= 0:
        return ""
    tail = text[-n:]
    if re.search(r"[.!?]\s*\Z", tail) and (m := re.search(r"\.\s+[A-Z]", tail)):
        return tail[m.start() + 2 :].strip()
    return tail.strip()


def fold_fixed(rows: Iterable[dict], c: Chunking) -> list[dict]:
    """Fill chunks up to the target; each begins with the end of the one before."""
    out, text, stack = [], "", []

    def emit() -> None:
        out.append({"content": text.strip(), "headings": list(stack), "overlap_chars": 0})

    for s in rows:
        head = s["section_type"] in ("heading", "title")
        pieces = [s["content"] or ""]
        if c.split_long and not head:
            pieces = [pieces[0][i : i + c.target] for i in range(0, len(pieces[0]), c.target)] or [""]
        if head:
            before, stack = stack, _push(stack, s)
            if c.preserve_headings and text:
                if c.own_heading:
                    after, stack = stack, before
                    emit()
                    stack = after
                else:
                    emit()
                text = _fixed_tail(text, c.overlap) + pieces[0] + "\n\n"
                continue
        for piece in pieces:
            piece += "\n\n" if s["section_type"] == "heading" else "" if piece.endswith("\n") else " "
            if text and len(text) + len(piece) > c.target:
                emit()
                text = _fixed_tail(text, c.overlap)
            text += piece
    if text:
        emit()
    return out


def _combine(rows: list[dict]) -> str:
    return "".join((s["content"] or "") + ("\n\n" if s["section_type"] in ("heading", "title") else "\n") for s in rows).strip()


def _break(rows: list[dict]) -> int:
    """How many sections go into the chunk when the target is reached; 0 if there's no good place."""
    n = len(rows)
    for i in range(n - 2, max(1, n * 2 // 3) - 1, -1):
        if rows[i]["section_type"] in ("heading", "paragraph"):
            return i + 1
    return 0


def fold_semantic(rows: Iterable[dict], c: Chunking) -> list[dict]:
    """Close chunks at major headings, before the maximum, and at good places beyond the target."""
    out, held, n, stack, last = [], [], 0, [], ""

    def emit(part: list[dict], heads: list[dict], overlap: str) -> str:
        text = _combine(part)
        joined = f"{overlap}\n\n{text}" if overlap else text
        out.append({"content": joined, "headings": list(heads), "overlap_chars": len(overlap)})
        return text

    for s in rows:
        size = len(s["content"] or "")
        if s["section_type"] in ("heading", "title"):
            before, stack = stack, _push(stack, s)
            if c.preserve_headings and s["level"] <= 2 and n and n >= c.min:
                last = emit(held, before if c.own_heading else stack[:-1], "")
                held, n = [s], size
                continue
        if n and n + size > c.max and n >= c.min:
            last = emit(held, stack, _semantic_tail(last, c.overlap))
            held, n = [s], size
            continue
        held, n = [*held, s], n + size
        if n >= c.target and (b := _break(held)):
            last = emit(held[:b], stack, _semantic_tail(last, c.overlap))
            held = held[b:]
            n = sum(len(x["content"] or "") for x in held)
    if held:
        emit(held, stack, _semantic_tail(last, c.overlap))
    return out


#: Strategies by name: (sections of one document, settings) to its chunks.
STRATEGIES: dict[str, Callable[[Iterable[dict], Chunking], list[dict]]] = {"fixed_size": fold_fixed, "semantic": fold_semantic}


def register_strategy(name: str, fold: Callable[[Iterable[dict], Chunking], list[dict]]) -> None:
    STRATEGIES[name] = fold


#: Characters of sections that are Python objects at once.
SLICE = 1 << 20


def merge_rows(chunks: list[dict], least: int = 500, most: int = 2500, slack: float = 1.1) -> list[dict]:
    """merge_small() of one document's chunks, in order."""
    out, i = [], 0
    while i < len(chunks):
        one = chunks[i]
        two = chunks[i + 1] if i + 1 < len(chunks) else None
        i += 1
        if two and len(one["content"]) < least and len(one["content"]) + len(two["content"]) <= int(most * slack):
            known = {h["content"] for h in one["headings"]}
            heads = one["headings"] + [h for h in two["headings"] if h["content"] not in known]
            one = one | {"content": one["content"] + "\n\n" + two["content"], "headings": sorted(heads, key=lambda h: h["level"])}
            i += 1
        out.append(one)
    return out


def chunk(docs: DataFrame, settings: Chunking = Chunking(), key: str = "doc_id", sections: str = "sections", merge: bool = False) -> DataFrame:
    """(key, sections) to (key, sequence, content, headings, overlap_chars); no section, no chunk.

    merge: small chunks take up their successors, as by merge_small(), and nothing is shuffled. Documents become Python
    objects by slices of SLICE characters, and their chunks leave as rows: a longer document is a slice of its own.
    """
    if settings.strategy not in STRATEGIES:
        raise ChunkingError(f"no chunking strategy is called {settings.strategy!r}; there are {sorted(STRATEGIES)}")
    fold = STRATEGIES[settings.strategy]
    kind = StructType.fromDDL(f"sequence int, content string, headings {HEADINGS}, overlap_chars int")
    arrow = to_arrow_type(kind.fields[2].dataType)

    def folded(col: pa.ListArray) -> tuple[list[int], list[int], list[dict]]:
        """The row and the sequence of each chunk, and the chunks."""
        flat = col.flatten()
        names = [f.name for f in flat.type]
        parts = list(zip(*[flat.field(i).to_pylist() for i in range(len(names))], strict=True))
        rows, sequence, out, at = [], [], [], 0
        for row, n in enumerate(pc.fill_null(pc.list_value_length(col), 0).to_pylist()):
            found = fold([dict(zip(names, p, strict=True)) for p in parts[at : at + n]], settings)
            if merge:
                found = merge_rows(found, settings.min, settings.max)
            at += n
            rows += [row] * len(found)
            sequence += range(len(found))
            out += found
        return rows, sequence, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                rows, sequence, out = folded(part.column(1))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(sequence, pa.int32()), pa.array([c["content"] for c in out], pa.string()), pa.array([c["headings"] for c in out], arrow), pa.array([c["overlap_chars"] for c in out], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[part.schema.names[0], *kind.names])
        give_back()

    asked = docs.select(key, sections)  # a filter on the sections would work them out once more
    return asked.mapInArrow(run, StructType([asked.schema[key], *kind.fields]))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE bytes of sections each."""
    lists = batch.column(column)
    size = pc.fill_null(pc.binary_length(lists.flatten().field("content")), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def fixed_overlap(c: Column | str, n: int) -> Column:
    """The end of a text: after its last sentence end within n characters, else its last three words."""
    c = T._col(c)
    tail = F.right(c, F.lit(n))

    def words(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.array_join(F.slice(t, -F.least(F.size(t), F.lit(3)), F.lit(3)), " ")).otherwise(F.right(c, F.lit(min(100, n))))

    after = F.regexp_extract(tail, r"(?s)^.*[.!?]\s(.*)\z", 1)
    return F.when(F.char_length(c) <= n, c).when(tail.rlike(r"[.!?]\s"), after).otherwise(T.let(T.tokens(tail), words))


def semantic_overlap(c: Column | str, n: int) -> Column:
    """The last n characters; if they end a sentence, from the first sentence that begins within them."""
    tail = F.right(T._col(c), F.lit(n))
    start = F.regexp_extract(tail, r"(?s)^.*?\.\s(\s*[A-Z].*)\z", 1)
    return T.strip(F.when(tail.rlike(r"[.!?]\s*\z") & tail.rlike(r"\.\s+[A-Z]"), start).otherwise(tail))


def merge_small(chunks: DataFrame, least: int = 500, most: int = 2500, key: str = "doc_id", slack: float = 1.1) -> DataFrame:
    """Append to each chunk under `least` characters its successor if both stay within most * slack, left to right.

    A merged chunk isn't looked at again. Whether a chunk may merge depends on its successor only, and within
    a run of such chunks every second one has been used up: so odd places of the run merge. One sort by document.
    Headings, if there, are united by content and ordered by level. Sequences are counted anew.
    """
    w = Window.partitionBy(key).orderBy("sequence")
    size = F.char_length("content")
    may = F.coalesce((size < least) & (size + F.lead(size).over(w) <= int(most * slack)), F.lit(False))
    df = chunks.withColumn("__may", may)
    df = df.withColumn("__run", F.sum(F.when(F.col("__may"), 0).otherwise(1)).over(w))
    # a run's members share __run with the chunk before it, which isn't eligible: counting the eligible alone gives the place
    df = df.withColumn("__place", F.sum(F.col("__may").cast("int")).over(Window.partitionBy(key, "__run").orderBy("sequence")))
    df = df.withColumn("__merges", F.col("__may") & (F.col("__place") % 2 == 1))
    df = df.withColumn("__eaten", F.coalesce(F.lag("__merges").over(w), F.lit(False))).withColumn("__next", F.lead("content").over(w))
    cols: dict[str, Column] = {"content": F.when(F.col("__merges"), F.concat_ws("\n\n", "content", "__next")).otherwise(F.col("content"))}
    if "headings" in chunks.columns:
        df = df.withColumn("__heads", F.lead("headings").over(w))
        cols["headings"] = F.when(F.col("__merges"), unite_headings("headings", "__heads")).otherwise(F.col("headings"))
    kept = df.where(~F.col("__eaten")).withColumns(cols).withColumn("sequence", F.row_number().over(w) - 1)
    return kept.select(chunks.columns)


def unite_headings(a: Column | str, b: Column | str) -> Column:
    """a and those of b with new contents, by level; ties as they came."""
    a, b = T._col(a), T._col(b)
    known = F.transform(a, lambda h: h["content"])
    both = F.concat(a, F.filter(b, lambda h: ~F.array_contains(known, h["content"])))
    keyed = F.transform(both, lambda h, i: F.struct(h["level"].alias("level"), i.alias("i"), h["content"].alias("content")))
    return F.transform(F.array_sort(keyed), lambda h: F.struct(h["content"].alias("content"), h["level"].alias("level")))


def context(chunks: DataFrame, title: Column | str | None = None) -> DataFrame:
    """Adds title (the document's, else a first heading of level 1), section_path and text_stats."""
    first = F.try_element_at("headings", F.lit(1))
    own = T._col(title) if title is not None else F.lit(None).cast("string")
    return chunks.withColumns({
        "title": F.coalesce(own, F.when(first["level"] == 1, first["content"])),
        "section_path": F.transform("headings", lambda h: h["content"]),
        "text_stats": T.text_stats("content"),
    })


def with_ids(chunks: DataFrame, doc_hash: Column | str) -> DataFrame:
    """chunk_id from the document's hash and the sequence: the same after every rerun."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", T._col(doc_hash), F.col("sequence").cast("string")), 256))
