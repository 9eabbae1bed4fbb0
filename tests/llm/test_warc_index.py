import hashlib
import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import warc_index as wi


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    runs = [[(x, i) for x in sorted(r)] for i, r in enumerate(runs)]
    assert list(wi.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_url_key(spark):
    urls = {"https://www.Example.com:443/A/b/?z=1&a=2#top": "com,example)/a/b?a=2&z=1", "http://m.x.org": "org,x)/", "x.org/": "org,x)/", None: "", " ": "", "ftp://u:p@h.net/q?": "net,h)/q"}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", wi.url_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in got} == urls


@pytest.mark.parametrize("ranged", [None, 40])
def test_histories_against_brute_force(spark, monkeypatch, ranged):
    if ranged:  # many ranges, most of them inside one URL's history or among repeats of one capture
        monkeypatch.setattr(wi, "RANGE_ROWS", ranged)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", "http://a.com/x", "https://www.a.com/x/", "b.org"]), rng.choice([None, "", "one", "two"]), rng.choice([None, 5, 6, 7]), "c") for _ in range(300)]
    rows += [(9, "http://a.com/x", "same", 6, "c")] * 80
    rows += [(1, "http://a.com/x", "y" * 2_000_000, 5, "c")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, captured_at bigint, digest string").repartition(7)
    got = wi.histories(pages).collect()
    keys = {None: "", "": "", "http://a.com/x": "com,a)/x", "https://www.a.com/x/": "com,a)/x", "b.org": "org,b)/"}
    md5 = hashlib.md5
    nul = lambda v: (v is not None, v or 0)
    want = sorted(((keys[u], nul(t), nul(p), md5((h or "").encode()).hexdigest()) for p, u, h, t, _ in rows))
    assert [(r.urlkey, nul(r.captured_at), nul(r.page_id), r.digest) for r in got] == want  # globally ordered, in the order of partitions
    last, n, before = None, 0, None
    for r in got:
        n = n + 1 if r.urlkey == last else 1
        assert r.capture_no == n and r.changed == (n == 1 or r.digest != before)
        last, before = r.urlkey, r.digest
    assert wi.histories(pages.limit(0)).count() == 0


def test_times_and_ids_of_any_type(spark):
    base = spark.createDataFrame([(9_000_000_000_000_000_000, "a.com", "x"), (-3, "a.com", "y"), (None, "a.com", "z")], "page_id bigint, url string, html string")
    got = wi.histories(base).collect()
    assert len(got) == 3 and all(r.captured_at is None or wi.EPOCH <= r.captured_at < wi.EPOCH + wi.YEAR for r in got)
    text = spark.createDataFrame([("p1", "a.com", "x", "2024-01-02T03:04:05Z"), ("p2", "a.com", "x", "1704164646"), ("p3", "a.com", "y", "never"), (None, "a.com", "y", None)], "page_id string, url string, html string, captured_at string")
    assert [(r.captured_at, r.capture_no, r.changed) for r in wi.histories(text).collect()] == [(None, 1, True), (None, 2, False), (1704164645, 3, True), (1704164646, 4, False)]
    for kind in ("array(1, 2)", "map('a', 1)", "named_struct('a', 1)", "true", "1.5d"):
        assert [r.captured_at for r in wi.captures(text.withColumn("captured_at", F.expr(kind))).collect()] == [None] * 4
    for kind, want in (("timestamp'2024-01-02 03:04:05'", 1704164645), ("date'2024-01-02'", 1704153600), ("timestamp_ntz'2024-01-02 03:04:05'", 1704164645), ("5s", 5)):
        assert [r.captured_at for r in wi.captures(text.withColumn("captured_at", F.expr(kind))).collect()] == [want] * 4
