"""Quality rules on repetition inside a document, from its suffix array.

The suffix array of each text's words is built by prefix doubling (only groups that still tie are sorted again), and
longest common prefixes of neighbours come from the ranks of the doublings. A run of neighbours whose
prefixes have at least `least` words is an interval of a repeated substring; for each of its suffixes, the longer
of the two neighbouring prefixes is the longest repeat that starts there, and each occurrence of each
maximal repeat lies in such a span. The spans' union gives the covered fraction of the text's characters (bytes
of words), their maximum the longest repeat. A document passes if neither exceeds its limit.

A word is a run of anything but white space; a character of a script without spaces is a word of its own.
Repeats may overlap, so one word said 30 times is a repeat of 29.

Nulls and odd input: a null or empty text repeats nothing: fraction 0, longest 0, and passes. A null doc_id is
handled like any other. Repeated rows get equal results, since documents are looked at one by one. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import textvec

#: Repeats of fewer words don't count (a word said 6 times is a repeat of 5); the limits of covered fraction and of
#: words in one repeat.
LEAST, MOST_COVERED, LONGEST = 5, 0.3, 60


def suffix_array(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, text by text, and their ranks by the first 1, 2, 4, ... words (equal if these are)."""
    n = len(ids)
    end = np.searchsorted(doc, doc, "right")
    _, dense = np.unique(ids, return_inverse=True)
    key = doc.astype(np.int64) * (int(dense.max()) + 1) + dense
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def place(at: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes at SA positions `at`; returns the positions that still tie."""
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = np.cumsum(new) - 1
        first = at[np.flatnonzero(new)]
        rank[sa[at]] = first[group]
        return at[np.bincount(group)[group] > 1]

    tied, levels, k = place(np.arange(n), key[sa]), [], 1
    levels.append(rank.astype(np.int32))
    while len(tied):
        pos = sa[tied]
        ahead = pos + k
        second = np.where(ahead < end[pos], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sa[tied] = pos[order]
        tied = place(tied, key[order])
        k *= 2
        levels.append(rank.astype(np.int32))
    return sa, levels


def neighbours(sa: np.ndarray, levels: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in the array with the one before; 0 across texts."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    end = np.searchsorted(doc, doc, "right")
    at = np.flatnonzero(doc[sa[1:]] == doc[sa[:-1]]) + 1
    a, b = sa[at - 1].copy(), sa[at].copy()
    ea, got = end[a], np.zeros(len(at), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        ok = (a < ea) & (b < ea)
        same = np.zeros(len(at), bool)
        same[ok] = levels[t][a[ok]] == levels[t][b[ok]]
        got[same] += 1 << t
        a[same] += 1 << t
        b[same] += 1 << t
    lcp[at] = got
    return lcp


def measure(texts: pa.Array, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered fraction, longest repeat in words, and number of repeated strings of `least` words, by text."""
    data, offsets = textvec.raw(texts)
    w = textvec.words(data, offsets, solid=True)
    docs, n = len(w.per_doc), len(w.hash)
    if n == 0:
        return np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    sa, levels = suffix_array(w.hash, w.doc)
    lcp = neighbours(sa, levels, w.doc)
    after = np.append(lcp[1:], 0)
    longest = np.maximum(lcp, after)
    longest[longest < least] = 0
    size = np.zeros(docs, np.int64)
    np.maximum.at(size, w.doc[sa], longest)
    hit = np.flatnonzero(longest)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, sa[hit], 1)
    np.add.at(edge, sa[hit] + longest[hit], -1)
    covered = np.cumsum(edge[:-1]) > 0
    length = w.end - w.start
    part = np.bincount(w.doc, length * covered, docs) / np.maximum(np.bincount(w.doc, length, docs), 1)
    opens = np.flatnonzero((after >= least) & (lcp < least))  # where an interval of repeated strings begins
    return part, size, np.bincount(w.doc[sa[opens]], minlength=docs)


def _rules(least: int, most: float, longest: int, scores: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches, "text", 2 << 20):
            part, size, strings = measure(b.column("text"), least)
            ok = pa.array((part <= most) & (size <= longest))
            if scores:
                b = pa.record_batch({"doc_id": b.column("doc_id"), "covered_fraction": pa.array(part), "longest_repeat": pa.array(size), "repeated_strings": pa.array(strings)})
            yield b.filter(ok)

    return run


def select(docs: DataFrame, least: int = LEAST, most: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """docs that pass, with their own columns."""
    return docs.mapInArrow(_rules(least, most, longest, False), docs.schema)


def scored(docs: DataFrame, least: int = LEAST, most: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """(doc_id, covered_fraction, longest_repeat, repeated_strings) of the documents that pass."""
    own = docs.select("doc_id", "text")
    return own.mapInArrow(_rules(least, most, longest, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, covered_fraction double, longest_repeat bigint, repeated_strings bigint")


def op7_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    """The documents that pass the repetition rules, with their measures."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
