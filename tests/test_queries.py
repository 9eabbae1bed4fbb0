"""Registered queries against their SQL in a second engine, plans, and the driver's contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from sparkloom.plans import catalogue
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    assert differences(spark, con, name, SF, catalogue.QUERIES, catalogue.ORACLES) == ""


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


#: Queries that are folds or fuzzy matching; every other one stays in the JVM.
PYTHON = {"chunk_fixed", "chunk_semantic", "page_headers_footers", "page_documents", "diversity_fuzzy", "qa_outcomes", "qa_document_stats"}


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in PYTHON])
def test_stays_in_the_jvm(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_only_read_columns_are_scanned(spark):
    plan = catalogue.QUERIES["document_hashes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
