import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import lang_id as li
from sparkloom.llm import textvec


def test_windows_cover_whole_texts():
    texts = pa.array(["a" * 500, "", None, "b" * li.WINDOW, "cé"])
    windows, doc, used = li.cut(*textvec.raw(texts))
    assert doc.tolist() == [0, 0, 0, 3, 4] and used.sum() == 500 + li.WINDOW + 3
    assert (windows[doc == 0] == ord("a")).sum() == 500 and windows[4, :3].tobytes() == "cé".encode()


def test_tables_equal_the_convolution():
    net = li.train(pa.array(["abc def " * 30, "xyz uvw " * 30] * 4), ["p", "q"] * 4, epochs=2)
    windows, _, _ = li.cut(*textvec.raw(pa.array(["hello world, abc", "xyz" * 100])))
    pooled = []
    for w, f in net.filters.items():
        e = net.embed[windows]
        pooled.append(np.stack([sum(e[:, i + k] @ f[k] for k in range(w)) for i in range(li.WINDOW - w + 1)], 1).max(1))
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(windows, net.tables()), want, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fit, held = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    got = li.identify(held, fit).join(held.select("doc_id", "lang"), "doc_id").where("length(lang) > 0")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_id")).cast("int"))).first()
    assert right / n > 0.98


def test_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("lang_id", F.lit(3)).withColumn("__id", F.lit("x"))
    odd = spark.createDataFrame([(None, "the of and", None), (-1, None, "en"), (-2, "", "en"), (-3, "the and of " * 100_000, None), (-4, "x", None), (-4, "x", None)], "doc_id bigint, text string, lang string")
    docs = base.unionByName(odd, allowMissingColumns=True)
    got = li.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[-1].lang_id is None and by[-2].lang_id is None and by[-2].confidence == 0 and by[-3].lang_id == "en"
    assert len({r.lang_id for r in got if r.doc_id == -4}) == 1
    assert li.identify(docs.limit(0)).count() == 0
    assert {r.lang_id for r in li.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}
    assert {r.lang_id for r in li.identify(odd.withColumn("lang", F.lit("fr"))).where("doc_id = -4").collect()} == {"fr"}
