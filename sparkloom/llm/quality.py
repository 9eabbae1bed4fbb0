"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector over hashed text for all grades, with ordered thresholds
t_0 < t_1 < ...; it gives each document an expected grade and the probability of the top tail. Grades here
come from labels: 0 poor quality, 1 acceptable but toxic, 2 good.

The hashed text has every word of the document and every run of GRAM bytes inside a word (the word's beginning
counts as one), each divided by the root of their number, and the shape of every white-space token (case, first
and last characters, whether it repeats the one before), as frequencies. The runs let compounds and inflected
forms that no training text has be told by their parts.

Nulls and odd input: a null or empty text, or white space only, has grade 0 and probability 0 and is rejected.
A null doc_id is scored like any other row; ids of documents and labels may be of any type, the same in both.
Of several texts of a labelled id the first in order is trained on. Repeated rows are scored alike. Labels with a null
quality or doc_id are left out; of several labels of a document the worst counts. With fewer than two
different grades among the labels everything with a word is kept, at the grade that there is (or the top one).
Other columns, whatever their names, pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec

BITS, GRADES, GRAM = 19, 3, 5
#: The classifier is fitted on at most so many labelled rows, chosen by a hash of their doc_id.
SAMPLE_ROWS = 6000
#: A document is kept if its probability of the top grade is at least this: the strictest of 0.7, 0.85 and 0.9
#: by which held-out clean documents stay and held-out toxic ones go (README, "Toxic documents").
KEEP = 0.9
#: The share of clean documents that may be lost so.
LOST = 0.01

_LOWER = np.zeros(256, bool)
_LOWER[[*range(97, 123), *range(128, 256)]] = True
_KIND = np.full(256, 3, np.uint64)  # punctuation and the like by itself, letters and digits by class
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 1


def grams(low: textvec.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of GRAM bytes inside a word; a word's beginning counts as a byte."""
    runs = np.maximum(low.end - low.start - GRAM + 2, 0)
    word = np.repeat(np.arange(len(runs)), runs)
    off = np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs) - 1
    at = low.start[word] + off
    h = np.where(off < 0, np.uint64(0), data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1)) if len(at) else np.zeros(0, np.uint64)
    for j in range(1, GRAM):
        h = h * np.uint64(0x100000001B3) + data[at + j] + np.uint64(1)
    return textvec.mix(h), low.doc[word]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Bucket, value and text of every feature occurrence, the number of texts, and each text's words."""
    texts = texts.cast(pa.large_string())
    data, offsets = textvec.raw(texts)
    solid = textvec.words(data, offsets, solid=True)
    lowered, edges = textvec.raw(pc.utf8_lower(texts))
    low = textvec.words(lowered, edges)
    part = np.uint64(1 << (BITS - 2))  # words, token shapes, and twice as many buckets for runs inside words
    run, owner = grams(low, lowered)
    bucket = [(low.hash & (part - np.uint64(1))).astype(np.int64), (part * np.uint64(2) + (run & (part * np.uint64(2) - np.uint64(1)))).astype(np.int64)]
    value, doc = [(1 / np.sqrt(np.maximum(low.per_doc, 1))).astype(np.float32)[low.doc]], [low.doc, owner]
    value.append((1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(low.per_doc)), 1))).astype(np.float32)[owner])
    if len(solid.hash):
        lower = np.concatenate([[0], np.cumsum(_LOWER[data], dtype=np.int32)])
        caps = (lower[solid.end] == lower[solid.start]) & (solid.end - solid.start > 1)
        last, first = data[solid.end - 1], data[solid.start]
        tail = np.where(_KIND[last] == 3, last.astype(np.uint64) + np.uint64(8), _KIND[last])
        head = np.where(_KIND[first] == 3, first.astype(np.uint64) + np.uint64(8), _KIND[first])
        again = np.zeros(len(solid.hash), bool)
        again[1:] = (solid.hash[1:] == solid.hash[:-1]) & (solid.doc[1:] == solid.doc[:-1])
        shape = textvec.mix(tail << np.uint64(20) | head << np.uint64(8) | caps.astype(np.uint64) << np.uint64(1) | again.astype(np.uint64))
        bucket.append((part + (shape & (part - np.uint64(1)))).astype(np.int64))
        value.append((4 / np.maximum(solid.per_doc, 1)).astype(np.float32)[solid.doc])
        doc.append(solid.doc)
    return np.concatenate(bucket), np.concatenate(value), np.concatenate(doc), len(solid.per_doc), solid.per_doc


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  #: ascending, one fewer than grades

    def latent(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, value, doc, n, words = features(texts)
        return np.bincount(doc, self.weights[bucket] * value, n), words

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the top grade."""
        s, words = self.latent(texts)
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -50, 50)))
        return np.where(words > 0, above.sum(1), 0.0), np.where(words > 0, above[:, -1], 0.0)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, bucket and summed value of each feature of each text, in order of both; made in slices to save memory."""
    docs, buckets, values, n = [], [], [], 0
    for b in textvec.slices(iter([pa.record_batch({"text": texts})]), "text", 1 << 20):
        bucket, value, doc, rows, _ = features(b.column("text"))
        key, where = np.unique(doc * (1 << BITS) + bucket, return_inverse=True)
        docs.append((n + (key >> BITS)).astype(np.int32))
        buckets.append((key & ((1 << BITS) - 1)).astype(np.int32))
        values.append(np.bincount(where, value, len(key)).astype(np.float32))
        n += rows
    return (*map(np.concatenate, (docs, buckets, values)), n)


def objective(w: np.ndarray, p: np.ndarray, doc: np.ndarray, col: np.ndarray, value: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades, and its gradients by weights and threshold parameters.

    P(grade = y) = sigmoid(t_y - s) - sigmoid(t_(y-1) - s), s being a text's sum of weight times value; p has the first
    threshold and the logarithms of the gaps to the next ones.
    """
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    n = len(grades)
    s = np.bincount(doc, w[col] * value, n)
    edge = np.concatenate([[-1e9], np.cumsum(np.concatenate([p[:1], np.exp(p[1:])])), [1e9]])
    hi, lo = sig(edge[grades + 1] - s), sig(edge[grades] - s)
    prob = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
    ds = (dhi - dlo) / n
    dt = -(np.bincount(grades, dhi, GRADES)[:-1] - np.bincount(grades, dlo, GRADES)[1:]) / n
    tail = np.cumsum(dt[::-1])[::-1]
    return float(-np.log(prob).mean()), np.bincount(col, ds[doc] * value, len(w)), np.concatenate([tail[:1], tail[1:] * np.exp(p[1:])])


def fit(texts: pa.Array, grades: np.ndarray, epochs: int = 60, l2: float = 1e-5, rate: float = 0.05, least: int = 3) -> Model:
    """Adam on the cumulative-link likelihood; features in fewer than `least` texts have weight 0."""
    seen = np.unique(grades)
    if len(seen) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -50.0) if not len(seen) else np.where(np.arange(GRADES - 1) < seen[0], -50.0, 50.0))
    doc, bucket, value, n = counted(texts)
    often = np.bincount(bucket, minlength=1 << BITS) >= least
    keep = often[bucket]
    doc, bucket, value = doc[keep], bucket[keep], value[keep]
    ids, col = np.unique(bucket, return_inverse=True)
    start = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(5)
    w, m, v = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    base = np.log(share / (1 - share))
    p = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 0.1))])  # thresholds: first, then log gaps
    pm, pv, step = np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = np.sort(order[at : at + 256])
            size = start[rows + 1] - start[rows]
            flat = np.repeat(start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            own, c, x = np.repeat(np.arange(len(rows)), size), col[flat], value[flat]
            _, g, dp = objective(w, p, own, c, x, grades[rows])
            g += l2 * w
            step += 1
            for theta, grad, mm, vv in ((w, g, m, v), (p, dp, pm, pv)):
                mm += 0.1 * (grad - mm)
                vv += 0.001 * (grad * grad - vv)
                theta -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[ids] = w
    return Model(full, np.cumsum(np.concatenate([p[:1], np.exp(p[1:])])))


def rated(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[pa.Array, np.ndarray]:
    """At most `rows` labelled texts with their grades, the same ones for the same tables."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null").groupBy(textvec.id_key(labels).alias("__id")).agg(F.min(grade).alias("__grade"))
    some = graded.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    got = docs.select(textvec.id_key(docs).alias("__id"), "text").where("__id is not null and text is not null").join(F.broadcast(some), "__id")  # at most SAMPLE_ROWS ids
    t = got.groupBy("__id").agg(F.min("text").alias("text"), F.first("__grade").alias("__grade")).toArrow().sort_by("__id")  # one text an id
    return t.column("text").combine_chunks(), t.column("__grade").to_numpy().astype(np.int64)


def calibrated(texts: pa.Array, grades: np.ndarray) -> Model:
    """The fit on all texts. If over LOST of the clean texts of a quarter fall below KEEP by the fit on the rest, as they
    do with few labels, thresholds move down until that many do."""
    model, order = fit(texts, grades), np.random.default_rng(7).permutation(len(grades))
    out, rest = order[: len(order) // 4], order[len(order) // 4 :]
    clean = out[grades[out] == GRADES - 1]
    if len(clean) and len(np.unique(grades[rest])) > 1:
        known, held = texts.take(pa.array(rest)), texts.take(pa.array(clean))
        held = held.filter(pc.invert(pc.is_in(held, value_set=known)))
        part = fit(known, grades[rest])
        tail = np.concatenate([[1.0], *(part.score(b.column("text"))[1] for b in textvec.slices(iter([pa.record_batch({"text": held})]), "text", 1 << 20))])
        low = np.clip(np.quantile(tail, LOST), 1e-6, KEEP)
        model.thresholds = model.thresholds - (np.log(KEEP / (1 - KEEP)) - np.log(low / (1 - low)))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return calibrated(*rated(docs, labels, rows))


def _select(model: Model, keep: float, scores: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches, "text", 1 << 18):
            expected, tail = model.score(b.column("text"))
            ok = pa.array(tail >= keep)
            if scores:
                b = pa.record_batch({"doc_id": b.column("doc_id"), "expected_grade": pa.array(expected), "tail_probability": pa.array(tail)})
            yield b.filter(ok)

    return run


def select(docs: DataFrame, labels: DataFrame, keep: float = KEEP, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs whose probability of the top grade is at least `keep`, with their own columns."""
    return docs.mapInArrow(_select(train(docs, labels, rows), keep, False), docs.schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects, with expected grade and probability of the top grade."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", "text").mapInArrow(_select(model, KEEP, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double")
