"""Language identification by a byte convolutional network.

Texts are cut into fixed windows of WINDOW bytes, which cover them whole. Byte embeddings pass filters of several
widths; each filter's maximum over the window feeds a ReLU and a softmax layer. A text's language has the
largest sum of its windows' log probabilities, each weighted by the bytes it holds. Embeddings, filters and the
softmax are trained with Adam in numpy on labelled windows.

At inference the embedding and the filters' columns are folded into tables over byte pairs, so that a filter of width
2k is the sum of k look-ups; the result is the convolution's.

Nulls and odd input: a null or empty text has lang_id null and confidence 0. A null doc_id is classified like any
other row. Ties go to the language that sorts first. Repeated rows get equal results. Labels that are null are not
trained on; with one language that one is the answer everywhere, with none the answer is null. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec

WINDOW = 192
WIDTHS, FILTERS, EMBED = (2, 4, 6), 16, 8
#: The network is trained on all windows of at most so many labelled texts of each language.
TEXTS = 200


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, window) padded with 0, their texts, and their bytes in use."""
    size = np.diff(offsets)
    count = -(-size // window)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    used = np.minimum(size[doc] - nth * window, window)
    out = np.zeros(len(doc) * window, np.uint8)
    # the texts are laid out at multiples of the window, each followed by its padding
    at = np.repeat((np.cumsum(count) - count) * window - offsets[:-1], size) + np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    out[at] = data
    return out.reshape(-1, window), doc, used


@dataclass
class Net:
    languages: list[str]
    embed: np.ndarray  #: (256, EMBED)
    filters: dict[int, np.ndarray]  #: width: (width, EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[int, np.ndarray]]:
        """For each width, its byte-pair tables (width / 2, 65536, FILTERS)."""
        t = []
        for w, f in self.filters.items():
            one = np.einsum("be,wef->wbf", self.embed, f)
            t.append((w, np.ascontiguousarray((one[0::2][:, :, None, :] + one[1::2][:, None, :, :]).reshape(w // 2, 65536, FILTERS), np.float32)))
        return t

    def log_probabilities(self, windows: np.ndarray, tables: list[tuple[int, np.ndarray]], step: int = 256) -> np.ndarray:
        result = []
        for at in range(0, len(windows), step):
            x = windows[at : at + step].astype(np.int32)
            pair = x[:, :-1] << 8 | x[:, 1:]
            pooled = []
            for w, t in tables:
                n = x.shape[1] - w + 1
                total = t[0][pair[:, :n]]
                for k in range(1, w // 2):
                    total += t[k][pair[:, 2 * k : 2 * k + n]]
                pooled.append(total.max(1))
            h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            z = h @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            result.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(result) if result else np.zeros((0, len(self.languages)), np.float32)

    def classify(self, texts: pa.Array, tables: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, its probability by the weighted mean of the windows, and whether there is a text."""
        data, offsets = textvec.raw(texts)
        windows, doc, used = cut(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        np.add.at(total, doc, self.log_probabilities(windows, tables) * (used / WINDOW)[:, None])
        mean = total / np.maximum(np.bincount(doc, used / WINDOW, len(total)), 1e-9)[:, None]
        best = total.argmax(1)
        p = np.exp(mean - mean.max(1, keepdims=True))
        return best, p[np.arange(len(p)), best] / p.sum(1), np.diff(offsets) > 0


def train(texts: pa.Array, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 3) -> Net:
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Net(
        languages,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if len(languages) < 2:
        return net
    windows, doc, _ = cut(*textvec.raw(texts))
    number = {x: i for i, x in enumerate(languages)}
    x, y = windows, np.array([number[x] for x in labels])[doc]
    short = rng.random(len(x)) < 0.3  # cut some of them, so that short texts are known too
    size = rng.integers(8, WINDOW, len(x))
    x = np.where(short[:, None] & (np.arange(WINDOW) >= size[:, None]), 0, x).astype(np.uint8)
    params = [net.embed, *net.filters.values(), net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb = x[rows].astype(np.int64), y[rows]
            e = net.embed[xb]
            pooled, arg = [], []
            for w, f in net.filters.items():
                n = WINDOW - w + 1
                z = sum(e[:, k : k + n] @ f[k] for k in range(w))
                a = z.argmax(1)
                arg.append(a)
                pooled.append(np.take_along_axis(z, a[:, None, :], 1)[:, 0])
            h0 = np.concatenate(pooled, 1) + net.bias
            h = np.maximum(h0, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            dh = (p @ net.out.T) * (h0 > 0)
            g_embed, g_filters = np.zeros_like(net.embed), []
            b = np.arange(len(yb))[:, None]
            for i, (w, f) in enumerate(net.filters.items()):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.empty_like(f)
                for k in range(w):
                    part = e[b, arg[i] + k]  # (batch, filters, embed)
                    g[k] = np.einsum("bfe,bf->ef", part, d)
                    np.add.at(g_embed, xb[b, arg[i] + k].ravel(), (d[:, :, None] * f[k].T[None]).reshape(-1, EMBED))
                g_filters.append(g)
            grads = [g_embed, *g_filters, dh.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= (rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, texts: int = TEXTS) -> tuple[pa.Array, list[str]]:
    """At most `texts` labelled texts of each language, by a hash of their doc_id."""
    rows = docs.select(textvec.id_key(docs).alias("__id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and __id is not null and text is not null and text <> ''")
    some = rows.select("lang", "__id", F.xxhash64("__id").alias("__h")).distinct().selectExpr("lang", "__id", "row_number() over (partition by lang order by __h, __id) as __n").where(f"__n <= {texts}").select("lang", "__id")
    got = rows.join(F.broadcast(some), ["lang", "__id"])  # at most TEXTS ids a language
    t = got.groupBy("lang", "__id").agg(F.min("text").alias("text")).toArrow().sort_by([("__id", "ascending"), ("lang", "ascending")])  # one text an id
    return t.column("text").combine_chunks(), t.column("lang").to_pylist()


def _identify(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        names = np.array(net.languages, object)
        for b in textvec.slices(batches, "text", 1 << 20):
            if len(names):
                best, p, there = net.classify(b.column("text"), tables)
                lang = pa.array([names[i] if t else None for i, t in zip(best, there, strict=True)], pa.string())
                p = np.where(there, p, 0.0)
            else:
                lang, p = pa.nulls(b.num_rows, pa.string()), np.zeros(b.num_rows)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_id": lang, "confidence": pa.array(p.astype(np.float64))})

    return run


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang_id, confidence) of every row; trained on `labelled` (its text and lang), or docs itself."""
    net = train(*sample(docs if labelled is None else labelled))
    return docs.select("doc_id", "text").mapInArrow(_identify(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_id string, confidence double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language and confidence."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
