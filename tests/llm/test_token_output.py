import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import token_output as to


def test_parts_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(to, "PART", 20)
    e = to.Encoder()
    for text in ["it's a  test\n\n of parts, and 1234 more \t words  " * 9, "x" * 500, " " * 300, "a  b \n" * 50, "éà ü 日本   z  " * 9]:
        assert e.encode(text).tolist() == e.own.encode_ordinary(text)
        assert "".join(e.parts(text)) == text


def test_round_trip_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = to.encoding()
    got = {r.doc_id: r for r in to.tokenize(docs).collect()}
    for r in docs.collect():
        assert own.decode(got[r.doc_id].tokens) == r.text and got[r.doc_id].n_tokens == len(got[r.doc_id].tokens)


@pytest.mark.parametrize("coding, want", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout(spark, tmp_path, coding, want):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    path = str(tmp_path / coding)
    to.write(docs, path, encoding=coding, row_group_bytes=1 << 19, page_rows=50)
    meta = pq.ParquetFile(glob.glob(path + "/*.parquet")[0]).metadata
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(3)}
        assert want in cols["tokens.list.element"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in cols.values() if c.path_in_schema == "doc_id")
        assert all(c.has_offset_index for c in cols.values())
    one = to.read(spark, path, "doc_id", "n_tokens", first=100, last=110)
    plan = one._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1].splitlines()[0] and "GreaterThanOrEqual(doc_id,100)" in plan
    assert one.count() == docs.where("doc_id between 100 and 110").count()
    with pytest.raises(ValueError):
        to.layout("none")


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (4, "word " * 300_000), (5, "a" * 200_000), (6, " " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit("x")).withColumn("n_tokens", F.lit(0))
    to.write(docs, str(tmp_path / "t"))
    got = to.read(spark, str(tmp_path / "t")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].tokens is None and by[1].n_tokens == 0 and by[2].tokens == []
    own = to.encoding()
    for d, t in rows[2:]:
        assert own.decode(by[d].tokens) == t
    to.write(docs.limit(0), str(tmp_path / "e"))
    assert to.read(spark, str(tmp_path / "e")).count() == 0
