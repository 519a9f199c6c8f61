"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from contract.compare import compare
from contract.registry import registered
from contract.views import TABLES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")

CHECKED = [
    "schema_listing",
    "ordered_sample",
    "profile_labelled",
    "profile_order_sheet",
    "top_values_documents",
    "relations_with_declared",
    "orphaned_keys",
    "quality_all_findings",
    "enrichment_dependencies",
    "redacted_documents",
    "entity_report",
    "fix_dry_runs",
    "fix_applied",
    "report_history",
]


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() == 6


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, database, name):
    query, sql = registered()[name]
    text, ok = compare(spark, database, SF, query, sql)
    assert ok, text


@needs_data
@pytest.mark.parametrize("name", ["profile_orders", "relations_inferred", "orphaned_keys", "quality_duplicate_rows"])
def test_no_cross_joins_and_no_python(spark, name):
    plan = registered()[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan
