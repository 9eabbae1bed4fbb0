import itertools
import random
import re

import numpy as np
from pyspark.sql import types as T

from sparkloom.llm import near_dedup as nd
from sparkloom.llm import textvec


def sets(text, k=nd.SHINGLE):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, threshold=nd.THRESHOLD):
    s = {d: sets(t) for d, t in rows if d is not None and sets(t)}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def closure(pairs):
    up = {}
    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_groups_match_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = brute(rows)
    want = closure(pairs)
    monkeypatch.setattr(nd, "MEMBERS", 3)  # bands and components in parts and blocks
    monkeypatch.setattr(nd, "BLOCK_DOCS", 3)
    got = {r.doc_id: r for r in nd.groups(docs).collect()}
    lost = [(a, b) for a, b in pairs if a not in got or b not in got or got[a].group_id != got[b].group_id]
    assert len(lost) <= 0.01 * len(pairs)
    for d, r in got.items():  # nothing is joined that brute force doesn't join
        assert want[d] == want[r.group_id]
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert lost or {d: r.links for d, r in got.items()} == links


def test_recall_near_the_threshold(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for _ in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        cut = rng.uniform(0.66, 0.9)  # so many words stay: Jaccard from about 0.5 on
        rows += [(n, " ".join(base)), (n + 1, " ".join(base[: int(len(base) * cut)] + [f"x{rng.randrange(10**6)}" for _ in range(int(len(base) * (1 - cut)))]))]
        n += 2
    pairs = brute(rows)
    got = {r.doc_id: r.group_id for r in nd.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.99 * len(pairs)


def test_pairs_of_sets_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if i % 3 else 4000, rng.integers(1, 50)).astype(np.uint64)) for i in range(120)]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    for most in (100, 64_000):
        real, nd._tiles.__defaults__ = nd._tiles.__defaults__, (most,)
        try:
            assert set(zip(*(x.tolist() for x in nd.near_pairs(sets, None, 0.5)))) == want
            i, j = nd.near_pairs(sets[:50], sets[50:], 0.5)
            assert set(zip(i.tolist(), (j + 50).tolist())) == {(a, b) for a, b in want if a < 50 <= b}
        finally:
            nd._tiles.__defaults__ = real


def test_odd_rows(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    edit = list(base)
    edit[200] = "other"
    rows = [(1, " ".join(base), "x"), (2, " ".join(edit), "x"), (3, None, "x"), (4, "", "x"), (5, " .. !", "x"), (None, " ".join(base), "y"), (6, " ".join(base).upper(), "x"), (6, " ".join(base).upper(), "x"), (7, "one", "z"), (8, "one", "z"), (9, "long " * 300_000, "z"), (10, "", "q")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("group_id", T.StringType())])
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r.group_id for r in nd.groups(docs).collect()}
    assert got == {1: 1, 2: 1, 6: 1, 7: 7, 8: 7}
    kept = nd.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 7), (False, 9), (False, 10), (True, 0)]
    assert nd.groups(docs.limit(0)).count() == 0
    # ids of any type; rows of one id with different words are different documents
    named = spark.createDataFrame([("a", " ".join(base)), ("b", " ".join(edit)), ("a", "quite another text"), ("c", "quite another text"), (None, "x")], "doc_id string, text string")
    assert nd.dedup(named).count() == 3


def test_estimate_is_corrected():
    rng = np.random.default_rng(3)
    regs, n = [], []
    shared = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for extra in (1000, 1000):
        h = np.concatenate([shared, rng.integers(0, 2**64, extra, dtype=np.uint64)])
        regs.append(nd.registers(h, np.zeros(len(h), np.int64), 1))
        n.append(len(h))
    est, used = nd.estimate(regs[0][0], nd.levels(np.array([n[0]]))[0], regs[1], nd.levels(np.array([n[1]])))
    assert used[0] == nd.BUCKETS and abs(est[0] - 0.6) < 0.15
    a, b = (nd.registers(rng.integers(0, 2**64, 256 * 50, dtype=np.uint64), np.repeat(np.arange(256), 50), 256) for _ in range(2))
    rate = ((a == b) & (a != nd.EMPTY)).sum() / ((a != nd.EMPTY) & (b != nd.EMPTY)).sum()
    assert abs(rate - nd.collision_rate(*[nd.levels(np.array([50]))] * 2)[0]) < 1.5e-3


def test_words_and_shingles_match_python():
    import pyarrow as pa

    texts = ["Ab cd, ef", "", None, "a  b\nc d e", "日本語 x", "y"]
    data, offsets = textvec.raw(pa.array([t and t.lower() for t in texts]))
    for step in (2, 1 << 20):
        w = textvec.words(data, offsets, step=step)
        assert w.per_doc.tolist() == [3, 0, 0, 5, 4, 1]
        assert [bytes(data[s:e]).decode() for s, e in zip(w.start, w.end)][:3] == ["ab", "cd", "ef"]
    h, doc = textvec.shingles(w, 3)
    assert np.bincount(doc, minlength=6).tolist() == [1, 0, 0, 3, 2, 1] and len(set(h.tolist())) == 7


def test_clusters_are_components_and_copies_are_cheap():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(1, 25)
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}

        def links(i, others, own):
            return np.array(list({int(g): int(j) for j, g in zip(others, own) if (int(j), i) in edges}.values()), np.int64)

        joins, first = nd.clusters(n, links)
        want = closure(edges)
        assert first.tolist() == [want.get(x, x) for x in range(n)]
        assert set(joins) <= edges and len(joins) == n - len(set(first.tolist()))
    tried = []
    nd.clusters(500, lambda i, others, own: (tried.append(len(others)), others)[1])
    assert sum(tried) == 499
