import itertools
import random
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing as pk
from sparkloom.llm import textvec


def check(tokens, bins, capacity):
    assert all(sum(n for _, _, n in b) <= capacity and b for b in bins)
    got = sorted(p for b in bins for p in b)
    want = sorted((d, s, min(capacity, n - s)) for d, n in enumerate(tokens) for s in range(0, n, capacity))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 260), max_size=60))
def test_every_piece_once_and_local_optimum(tokens):
    bins = pk.pack(tokens, 100)
    check(tokens, bins, 100)
    size = [[n for _, _, n in b] for b in bins]
    for a, b in itertools.permutations(range(len(size)), 2):
        fa, fb = sum(size[a]), sum(size[b])
        if max(fa, fb) == 100:
            continue
        better = lambda d: fa + d <= 100 and fb - d <= 100 and (fa + d) ** 2 + (fb - d) ** 2 > fa**2 + fb**2
        assert not any(better(y) for y in size[b])  # no move
        assert not any(better(y - x) for y in size[b] for x in size[a])  # nor any exchange, whichever bin is fuller
        assert not any(better(y - x - z) for y in size[b] for x, z in itertools.combinations(size[a], 2))


def test_exchanges_with_emptier_bins():
    for sizes, want in (([[13, 7, 5], [18, 20]], 2129), ([[3, 2], [16, 19, 4]], 1616)):
        flat = [n for b in sizes for n in b]
        place = iter(range(len(flat)))
        got = pk.improve([[next(place) for _ in b] for b in sizes], flat, 40)
        assert sum(sum(flat[i] for i in b) ** 2 for b in got) >= want


def test_large_shards_are_quick():
    rng = random.Random(8)
    for low, high, docs in ((600, 1200, 8192), (1, 4000, 8192), (200, 700, 8192)):
        tokens = [rng.randint(low, high) for _ in range(docs)]
        began = time.process_time()
        bins = pk.pack(tokens)
        assert time.process_time() - began < 20, (low, high)  # seconds on a slow machine; quadratic search took minutes
        check(tokens, bins, 2048)


def test_token_edges():
    texts = ["a  b", "c", "", None, " \n", "é x\ty ", "z"]
    data, offsets = textvec.raw(pa.array(texts))
    start, end, n = pk.token_edges(data, offsets)
    assert n.tolist() == [2, 1, 0, 0, 0, 3, 1]
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["a", "b", "c", "é", "x", "y", "z"]


def test_few_bins():
    rng = random.Random(4)
    for _ in range(20):
        parts = []
        for _ in range(30):  # a perfect packing exists
            cut = sorted(rng.sample(range(1, 100), 3))
            parts += [b - a for a, b in itertools.pairwise([0, *cut, 100])]
        rng.shuffle(parts)
        bins = pk.pack(parts, 100)
        assert len(bins) <= 32
        order = sorted(parts, reverse=True)
        assert len(bins) <= len(pk.best_fit(order, 100))


def test_odd_rows(spark):
    rows = [(1, "a b c", "k"), (1, "a b c", "k"), (2, None, "k"), (3, " \n", "k"), (None, "x y", "k"), (None, "x y", "k"), (4, "w" + " w" * 4999, "k"), (5, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    for text in (False, True):
        out = pk.packed(docs, 1000, text).collect()
        assert sum(r.tokens for r in out) == 5010 and all(r.tokens <= 1000 for r in out)
        assert sorted(str(d) for r in out for d in r.doc_ids) == ["1", "1", "4", "4", "4", "4", "4", "None", "None"]
    assert sorted(len(t.split()) for r in out for t in r.texts) == [2, 2, 3, 3, 1000, 1000, 1000, 1000, 1000]
    assert pk.packed(docs.limit(0)).count() == 0
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert {d for r in pk.packed(named, 1000).collect() for d in r.doc_ids} == {"d1", "d4", None}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(r.text.split()) for r in docs.collect() if r.text.split()}
    got = {}
    for r in pk.packed(docs, shard_docs=50).collect():
        for d, n in zip(r.doc_ids, r.lengths):
            got[d] = got.get(d, 0) + n
    assert got == want
