import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import repetition as rp


def brute(words, least):
    """Covered words and the longest repeat, by comparing all pairs of suffixes."""
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered |= {*range(i, i + k), *range(j, j + k)}
    size = sum(len(w) for w in words)
    return (sum(len(words[i]) for i in covered) / size if size else 0.0), longest


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc"]), max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_against_brute_force(docs, least):
    part, size, strings = rp.measure(pa.array([" ".join(d) for d in docs]), least)
    for d, p, s, n in zip(docs, part, size, strings):
        want = brute(d, least)
        assert abs(p - want[0]) < 1e-9 and s == want[1]
        grams = [tuple(d[i : i + least]) for i in range(len(d) - least + 1)]
        assert n == sum(grams.count(g) > 1 for g in set(grams))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    ids, doc = rng.integers(0, 3, 200), np.sort(rng.integers(0, 4, 200))
    sa, levels = rp.suffix_array(ids, doc)
    _, dense = np.unique(ids, return_inverse=True)
    suffix = [(doc[i], *dense[i : np.searchsorted(doc, doc[i], "right")]) for i in sa]
    assert suffix == sorted(suffix)
    lcp = rp.neighbours(sa, levels, doc)
    for r in range(1, 200):
        a, b = suffix[r - 1], suffix[r]
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[r] == max(0, k - 1)


def test_odd_rows(spark):
    line = "this is a line of quite a few words that is said twice here in full"
    fresh = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, fresh), (3, fresh), (None, fresh), (4, "\n".join([line] * 30)), (5, "word " * 300_000), (6, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as covered_fraction")
    out = rp.select(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "3", "6", "None"]
    assert sorted(str(r.doc_id) for r in rp.scored(docs).collect()) == ["1", "2", "3", "3", "6", "None"]
    assert rp.select(docs.limit(0)).count() == 0


def test_short_repeats_count(spark):
    """Every word said 6 to 12 times; a line of 8 words between other lines, again and again; and what must stay."""
    stutter = " ".join(" ".join([f"w{i}"] * (6 + i % 7)) for i in range(30))
    rng = np.random.default_rng(3)
    other = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    line = "click here to read more of our stories"
    between = "\n".join(f"{line}\n{other(6)}" for _ in range(20))
    seldom = "\n".join([line, other(200), line, other(200)])
    docs = spark.createDataFrame([(1, stutter), (2, between), (3, seldom)], "doc_id bigint, text string")
    assert [r.doc_id for r in rp.scored(docs).collect()] == [3]


def test_good_documents_pass(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id").cache()
    assert rp.scored(good).count() > 0.997 * good.count()
    assert not rp.scored(docs.where("doc_id in (772, 7042, 8833)")).count()
