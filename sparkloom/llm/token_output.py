"""Token ids as Parquet list columns, with chosen encodings, row groups and page indexes.

Texts are tokenised whole with a byte-level BPE vocabulary. A long text is cut where white space begins, always a
boundary of the tokenizer's own pattern, so the ids of a long text's parts are exactly those of the whole.
Rows are sorted by doc_id inside each file and written by Spark with the dictionary or delta encoding of the ids, a
row group size, a page row limit and column and offset indexes; a reader of some columns or a doc_id range then skips
the other pages.

Nulls and odd input: a null text has null tokens and n_tokens 0; an empty one an empty list. Rows with a null
doc_id and repeated rows stay as they are, nulls first in each file. An empty table gives an empty table with the
schema. Ids that aren't whole numbers are stored as a 64-bit hash. Special tokens' strings in a text are ordinary text. Other columns are not kept.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import textvec
from sparkloom.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded in parts of about so many characters.
PART = 100_000
_EDGE = re.compile(r"\S(?=[ \n\r\t])")

SCHEMA = "doc_id bigint, n_tokens int, tokens array<int>"


def lines(vocabulary: str = VOCABULARY) -> bytes:
    """The vocabulary file, as the driver reads it; executors get its bytes with the task."""
    with open(os.fspath(vocabulary), "rb") as f:
        return f.read()


def encoding(vocabulary: str | bytes = VOCABULARY):
    import tiktoken

    own = vocabulary if isinstance(vocabulary, bytes) else lines(vocabulary)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, own.splitlines())}
    return tiktoken.Encoding("sparkloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """encode() gives the ids of the whole text; a long text goes in parts that end where white space begins."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY):
        self.own = encoding(vocabulary)

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            m = _EDGE.search(text, at + PART)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self.own.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([self.own.encode_to_numpy(p, disallowed_special=()) for p in self.parts(text)])


def _encode(vocabulary: bytes):
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b in textvec.slices(batches, "text", 2 << 20):
            texts = b.column("text").to_pylist()
            ids = [encoder.encode(t) if t else np.zeros(0, np.uint32) for t in texts]
            n = np.array([len(x) for x in ids])
            offsets = np.concatenate([[0], np.cumsum(n)])
            starts = pa.array([None if t is None else int(o) for t, o in zip(texts, offsets, strict=False)] + [int(offsets[-1])], pa.int32())
            tokens = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(ids).astype(np.int32)), kind)
            yield pa.record_batch([b.column("doc_id"), pa.array(n.astype(np.int32)), tokens], names=["doc_id", "n_tokens", "tokens"])

    return run


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row."""
    return docs.select(textvec.id_key(docs).alias("doc_id"), "text").mapInArrow(_encode(lines(vocabulary)), SCHEMA)


def layout(encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 500, page_bytes: int = 1 << 20) -> dict[str, str]:
    """Writer options. encoding: 'dictionary' of the ids, or 'delta' (binary packed); counts and doc_ids are delta coded."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be 'dictionary' or 'delta', not {encoding!r}")
    return {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, **options) -> None:
    """Tokenise docs and write them at path; options as for layout()."""
    tokenize(docs, vocabulary).sortWithinPartitions("doc_id").write.options(**layout(**options)).parquet(path)


def read(spark: SparkSession, path: str, *columns: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The given columns (all, without any) of doc_ids from first to last; the bounds reach the page indexes."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df.select(*columns) if columns else df


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, as read from the table written for them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return materialize(tokenize(docs).sortWithinPartitions("doc_id"), "tokens", **layout())
