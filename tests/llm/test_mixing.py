import hashlib
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from sparkloom.llm import mixing as mx


def pour(budget, kids):
    """Water-filling by repeated saturation: {name: (weight, capacity)} to {name: tokens}."""
    out, open_ = {}, {k: v for k, v in kids.items() if v[0] > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if Fraction(budget * w, total) >= c}
        if not full:
            out |= {k: budget * w // total for k, (w, _) in open_.items()}
            break
        for k in full:
            out[k] = open_[k][1]
            budget -= open_.pop(k)[1]
    return out


def brute(rows, ratio, epochs, weights, seed):
    weight = lambda *p: weights.get("/".join(p), 1)
    leaves = defaultdict(list)
    for d, t, lang, source in rows:
        n = len((t or "").split())
        digits = ""
        while source and source[len(source) - len(digits) - 1 : len(source) - len(digits)].isdigit():
            digits = source[len(source) - len(digits) - 1 :]
        domain = "unknown" if source is None else mx.DOMAINS[int(digits) % 4] if digits else "other"
        if n:
            leaves[domain, lang or "unknown", "unknown" if source is None else source].append((d, n))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    cap = lambda *p: epochs * sum(v for k, v in size.items() if k[: len(p)] == p)
    alloc = {}
    for d, b in pour(int(sum(size.values()) * ratio), {x: (weight(x), cap(x)) for x in {k[0] for k in size}}).items():
        for lg, c in pour(b, {x: (weight(d, x), cap(d, x)) for x in {k[1] for k in size if k[0] == d}}).items():
            for s, a in pour(c, {x: (weight(d, lg, x), cap(d, lg, x)) for x in {k[2] for k in size if k[:2] == (d, lg)}}).items():
                alloc[d, lg, s] = a
    out = []
    for k, a in alloc.items():
        whole, part = divmod(a, size[k])
        key = lambda d: hashlib.md5(f"{seed}/{whole}/{'null' if d is None else d}".encode()).hexdigest()
        out += [(d, e) for d, _ in leaves[k] for e in range(whole)]
        out += [(d, whole) for d, _ in leaves[k] if sum(n for x, n in leaves[k] if key(x) <= key(d)) <= part]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    for ratio, epochs, weights in [(1.0, 2, mx.WEIGHTS), (0.3, 1, {}), (5.0, 3, {"web": 9, "web/fr": 0, "books/en/src1": 50})]:
        index, cuts = mx.plan(docs, ratio, epochs, weights, 5)
        got = sorted(((r.doc_id, r.epoch) for r in mx.chosen(index, cuts, 5).collect()), key=repr)
        assert got == brute(rows, ratio, epochs, weights, 5)


def test_odd_rows(spark):
    rows = [(1, "a b c", "en", "src1", 1), (1, "a b c", "en", "src1", 1), (2, None, "en", "src1", 1), (3, " ", "en", "src1", 1), (None, "x y", None, None, 2), (4, "w " * 200_000, "de", "blog", 3), (5, "q", "de", "blog", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens int").withColumn("whole", F.lit(1)).withColumn("domain", F.lit("k"))
    out = mx.mix(docs, 9.0, 1, {})
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 1, 4, 5]
    twice = mx.mix(docs, 9.0, 2, {}).count()
    assert twice == 10
    assert mx.mix(docs.limit(0)).count() == 0


def test_own_domain_and_types(spark):
    rows = [(f"id{i}", "a b c", "law" if i % 2 else None, "en", f"src{i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, domain string, lang string, source string")
    index, _ = mx.plan(docs)
    assert {(r.domain, r.source) for r in index.collect()} == {(d, f"src{i}") for d in ("law", "unknown") for i in range(3)}
    assert mx.mix(docs, 1.0, 1).count() == 12
    odd = docs.withColumn("lang", F.lit(7)).withColumn("domain", F.array(F.lit(1)))
    assert {(r.domain, r.lang) for r in mx.plan(odd)[0].collect()} == {("[1]", "7")}
