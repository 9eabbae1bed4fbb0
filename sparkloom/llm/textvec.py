"""Vectorised text hashing over Arrow batches: words, word shingles, byte n-grams, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import give_back

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POS = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes that aren't ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[0, 9, 10, 11, 12, 13, 32]] = False
#: Lead bytes of scripts written without spaces (U+3000 to U+CFFF): each character starts a word.
_SINGLE = np.zeros(256, bool)
_SINGLE[0xE3:0xED] = True


def id_key(df: DataFrame, column: str = "doc_id") -> Column:
    """An id as bigint: whole numbers as they are, ids of any other type (strings, decimals, structs) by a 64-bit hash of
    their text; null stays null."""
    own = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return own.cast("bigint")
    text = F.to_json(F.struct(own)) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else own.cast("string")
    return F.when(own.isNotNull(), F.xxhash64(text))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of batches with at most so many bytes of text each; a longer text comes alone, whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    hash: np.ndarray  #: uint64 of each word
    doc: np.ndarray  #: the text it stands in
    start: np.ndarray  #: byte offset in the concatenated texts
    end: np.ndarray
    per_doc: np.ndarray  #: words of each text


def words(data: np.ndarray, offsets: np.ndarray, solid: bool = False, step: int = 1 << 20) -> Words:
    """Hashed words: runs of letters, digits and non-ASCII characters (solid: of anything but white space)."""
    table, n, docs = (SOLID if solid else _WORD), len(data), len(offsets) - 1
    hashes, starts, ends, at = [], [], [], 0
    first = np.unique(offsets[:-1])
    while at < n:
        to = min(n, at + step)
        if to < n:
            gap = np.flatnonzero(~table[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # one word up to here; it ends where the next other byte is, however far
                while to < n:
                    rest = np.flatnonzero(~table[data[to : to + (4 << 20)]])
                    if len(rest):
                        to += int(rest[0]) + 1
                        break
                    to = min(n, to + (4 << 20))
        part = data[at:to]
        word = table[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | _SINGLE[part[1:]]
        inside = first[np.searchsorted(first, at) : np.searchsorted(first, to)] - at
        begin[inside] |= word[inside]
        s = np.flatnonzero(begin)
        if len(s):
            last = word.copy()
            last[:-1] &= ~word[1:] | begin[1:]
            e = np.flatnonzero(last) + 1
            size = e - s
            upto = np.cumsum(size)
            pos = np.arange(upto[-1]) - np.repeat(upto - size, size)
            value = _BYTE[part[word]] * _POS[pos & 0xFFFF]
            hashes.append(mix(np.add.reduceat(value, upto - size) + size.astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(docs, np.int64))
    start = np.concatenate(starts)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(np.concatenate(hashes), doc, start, np.concatenate(ends), np.bincount(doc, minlength=docs))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words and their texts; a text of 1 to k-1 words has one shingle of them all."""
    n = len(w.hash)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.empty(n, np.int64)  # words from here to the text's end
    ends = np.cumsum(w.per_doc)
    left = ends[w.doc] - np.arange(n)
    at = np.flatnonzero((left >= k) | ((w.per_doc[w.doc] < k) & (left == w.per_doc[w.doc])))
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = np.minimum(at + j, n - 1)
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + np.where(left[at] > j, w.hash[here], np.uint64(7)))
    return total, w.doc[at]
