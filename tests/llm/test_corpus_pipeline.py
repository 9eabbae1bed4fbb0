"""The corpus pipeline's stages against brute force, and odd rows through all of them."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkloom.llm import mixing, packing, pii, quality
from sparkloom.session import materialize
from tests.llm import test_mixing, test_near_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        made = materialize(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def test_names_and_columns(spark, stages):
    assert list(stages) == ["quality_classifier", "near_dedup", "pii", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages[name][3] == spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(a and b for a, b, _, _ in stages.values())


def test_quality_stage(spark, stages):
    before, after, _, _ = stages["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    _, tail = model.score(pa.array([r.text for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, t in zip(before, tail) if t >= quality.KEEP)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    kept = {r.doc_id for r in after}
    assert len(good & kept) > 0.95 * len(good)


def test_near_dedup_stage(stages):
    before, after, _, _ = stages["near_dedup"]
    group = test_near_dedup.closure(test_near_dedup.brute([(r.doc_id, r.text) for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if group.get(r.doc_id, r.doc_id) == r.doc_id)


def test_pii_stage(stages):
    before, after, _, _ = stages["pii"]
    tagger, new = pii.Tagger(pii.train()), {r.doc_id: r for r in after}
    assert len(new) == len(after) == len(before)
    for r in before:
        want = pii.redacted(r.text, tagger.entities(r.text))
        assert new[r.doc_id].text == want and new[r.doc_id].n_chars == len(want) and new[r.doc_id].source == r.source
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w+", r.text) for r in after)


def test_mixing_stage(stages):
    before, after, _, _ = stages["mixing"]
    want = test_mixing.brute([(r.doc_id, r.text, r.lang, r.source) for r in before], cp.MIX_RATIO, cp.MIX_EPOCHS, mixing.WEIGHTS, mixing.SEED)
    assert sorted(r.doc_id for r in after) == sorted(d for d, _ in want)


def test_packing_stage(stages):
    before, after, _, _ = stages["packing"]
    words = {r.doc_id: r.text.split() for r in before if r.text.split()}
    got = {}
    for r in after:
        assert r.tokens == sum(r.lengths) <= packing.CAPACITY
        for d, s, n, t in zip(r.doc_ids, r.starts, r.lengths, r.texts):
            assert t.split() == words[d][s : s + n]
            got[d] = got.get(d, 0) + n
    assert got == {d: len(w) for d, w in words.items()}


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.shard, r.bin, r.tokens, r.doc_ids, r.starts, r.lengths, r.texts)
    assert sorted(map(key, cp.run(spark, SF).collect())) == sorted(map(key, stages["packing"][1]))


def test_odd_rows_through_all_stages(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "plain text", "en", "src1", 10), (-1, None, None, None, None), (-2, "", "en", None, 0), (-3, " \n\t", None, "src1", 3), (-4, "word " * 300_000, "en", "src2", None), (-5, "same words in here", "en", "src1", 5), (-5, "same words in here", "en", "src1", 5), (-6, "x" * 1_000_000, "zz", "", 1)]
    docs = good.unionByName(spark.createDataFrame(odd, good.schema)).withColumn("id", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("tokens", F.lit("t")).withColumn("component", F.lit(None).cast("int"))
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), f"odd-{name}")
    assert docs.count() > 0
    for _, stage in cp.STAGES:
        assert stage(spark, good.limit(0), SF).count() == 0
