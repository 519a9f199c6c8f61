import math
import random
import struct

import pytest

from plumbline import profile_tables
from plumbline.operators import numbers, quality as Q
from plumbline.operators.profile import column_sites
from plumbline.operators.relations import infer_relations
from plumbline.sources.settle import settle
from tests.samples import clean_orders, employees, sales, shop


def found(tables, **options):
    profile = settle(profile_tables(tables))
    rows = Q.quality_findings(tables, profile, **options).collect()
    return {(r["tables"][0], r["column"], r["code"]): r for r in rows}


def test_sales_sheet(spark):
    got = found({"sales": sales(spark)})
    expected = {
        ("total_price", "ALL_NULL"): "critical",
        ("email", "NULL_EXCESS"): "low",
        ("quantity", "NULL_EXCESS"): "low",
        ("order_date", "INCONSISTENT_FORMAT"): "medium",
        ("email", "INCONSISTENT_FORMAT"): "medium",
        ("unit_price", "OUTLIER"): "high",
        (None, "POSSIBLE_DUPLICATE"): "medium",
    }
    assert {(c, code): r["severity"] for (_, c, code), r in got.items()} == expected
    assert got["sales", "email", "INCONSISTENT_FORMAT"]["evidence"]["malformed"] == 1
    assert got["sales", None, "POSSIBLE_DUPLICATE"]["evidence"]["duplicate_rows"] == 1
    assert got["sales", "order_date", "INCONSISTENT_FORMAT"]["fix_risk"] == "green"
    assert got["sales", "total_price", "ALL_NULL"]["fix"] is None


def test_employee_sheet(spark):
    got = found({"employees": employees(spark)})
    assert {(c, code): r["severity"] for (_, c, code), r in got.items()} == {
        ("employee_id", "POSSIBLE_DUPLICATE"): "critical",
        ("employee_id", "CARDINALITY_ANOMALY"): "medium",
        (None, "POSSIBLE_DUPLICATE"): "medium",
        ("salary", "NEGATIVE_VALUE"): "high",
        ("salary", "NULL_EXCESS"): "low",
        ("email", "NULL_EXCESS"): "low",
        ("manager_id", "NULL_EXCESS"): "medium",
        ("department", "INCONSISTENT_FORMAT"): "medium",
    }
    assert got["employees", "department", "INCONSISTENT_FORMAT"]["evidence"] == {
        "labels": 1.0, "spellings": 2.0, "rows": 11.0,
    }


def test_clean_table_is_silent(spark):
    tables = {"orders": clean_orders(spark)}
    assert found(tables, formulas=[Q.Formula("orders", "total_price", "quantity", "unit_price")]) == {}


def test_shop(spark):
    got = found(shop(spark))
    assert got["customers", "email", "NULL_EXCESS"]["severity"] == "medium"
    assert got["customers", "phone", "NULL_EXCESS"]["severity"] == "high"
    assert got["customers", "tier", "NULL_EXCESS"]["severity"] == "medium"  # exactly 5 percent
    assert got["products", "price", "NULL_EXCESS"]["severity"] == "medium"
    assert got["customers", "spend", "OUTLIER"]["evidence"]["p95"] == 5700.0


def test_long_labels_differ_beyond_their_beginning(spark):
    long = "x" * 300
    labels = [long + "A", long + "a", long + "b", "One", "one ", "two"] * 5
    df = spark.createDataFrame([(v,) for v in labels], "v string")
    row = Q.label_findings({"t": df}, [("t", "v")]).first()
    assert row["evidence"] == {"labels": 2.0, "spellings": 4.0, "rows": 20.0}


def test_orphans_follow_relations(spark):
    tables = shop(spark)
    tables["customers"] = tables["customers"].where("customer_id <> 1")
    profile = settle(profile_tables(tables))
    relations = settle(infer_relations(profile, singular_names=True))
    rows = Q.quality_findings(tables, profile, relations).where("code = 'ORPHANED_FK'").collect()
    assert [(r["tables"], r["column"], r["evidence"]["orphan_rows"]) for r in rows] == [(["orders"], "customer_id", 2.0)]


def test_given_keys_are_counted_over_the_table(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, None), (2, None)], "a int, b int")
    assert tuple(Q.duplicate_keys(df, ["a", "b"]).first()) == (1, 1)
    got = found({"t": df}, keys={"t": ["a", "b"]})
    assert got["t", "a, b", "POSSIBLE_DUPLICATE"]["severity"] == "critical"


def test_duplicate_rows_keep_columns_and_nulls_apart(spark):
    df = spark.createDataFrame(
        [(1, "ab", "c", 1.0), (2, "a", "bc", 1.0), (3, None, "abc", 1.0), (4, "abc", None, 1.0), (5, "ab", "c", 1.0)],
        "id int, x string, y string, z double",
    )
    assert tuple(Q.duplicate_rows(df, ["id"]).first()) == (1, 1)


def test_formula(spark):
    df = spark.createDataFrame([("2", "3.5", 7.0), ("2", "x", 9.0), ("4", "2", 8.5)], "a string, b string, c double")
    row = Q.formula_findings({"t": df}, [Q.Formula("t", "c", "a", "b")]).first()
    assert row["evidence"] == {"violations": 1.0, "checked": 2.0}


def test_table_without_checkable_columns(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS day")
    assert Q.value_scan({"t": df}).count() == 0
    assert Q.outlier_findings({"t": df}).count() == 0


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("q", [0.05, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, seed, q):
    rng = random.Random(seed)
    columns = {
        "hot": [5.0 if rng.random() < 0.4 else rng.uniform(0, 10) for _ in range(999)],
        "huge": [rng.gauss(0, 1) for _ in range(998)] + [1e300, -1e300],
        "flat": [2.5] * 40,
        "few": [1.0, 2.0, 3.0],
    }
    rows = [(k, v) for k, vs in columns.items() for v in vs]
    rng.shuffle(rows)
    cids = {k: i for i, k in enumerate(columns)}
    df = spark.createDataFrame([(cids[k], v) for k, v in rows], "cid int, x double").repartition(5)
    got = numbers.percentile_discrete(df, numbers.moments(df), q, bits=4)
    got = {r["cid"]: r["percentile"] for r in got.collect()}
    for name, values in columns.items():
        assert got[cids[name]] == sorted(values)[math.ceil(q * len(values)) - 1], name


def as_ordered(x):
    bits = int.from_bytes(struct.pack(">d", abs(x)))
    return -bits if x < 0 else bits


def test_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 8.98846567431158e307]
    for e in range(-1074, 1024):
        near = [math.ldexp(1.0, e)]
        near += [math.nextafter(near[0], 0.0), math.nextafter(near[0], math.inf)]
        xs += near + [-y for y in near]
    xs += [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", numbers.order_bits("x").alias("bits")).collect()
    assert [(r["x"], r["bits"]) for r in got if r["bits"] != as_ordered(r["x"])] == []


def test_levels_are_bounded_for_heavy_tails(spark):
    """Values over all magnitudes: no level counts more than 2 ** 16 slices of a column."""
    df = spark.range(200_000).selectExpr("CAST(id % 2 AS INT) AS cid", "IF(id % 2 = 0, exp(abs(hash(id)) / 3.1e6), -id * 1e-9) AS x")
    moments = numbers.moments(df)
    state = moments.selectExpr("cid", "lo", "hi", "CAST(ceil(n * 0.95) AS BIGINT) AS rank", "0L AS below")
    shift, most = 64, []
    while shift:
        shift -= 16
        counted = numbers.radix_counts(df, state, shift)
        most.append(counted.groupBy("cid").count().agg({"count": "max"}).first()[0])
        state = spark.createDataFrame(numbers._selected(counted, state).collect(), "cid int, lo double, hi double, rank long, below long")
    assert max(most) <= 1 << 16 and most[-1] >= 1
    got = {r["cid"]: r["percentile"] for r in numbers.percentile_discrete(df, moments, 0.95).collect()}
    for cid in (0, 1):
        xs = sorted(r["x"] for r in df.where(f"cid = {cid}").select("x").collect())
        assert got[cid] == xs[math.ceil(0.95 * len(xs)) - 1]


def test_outlier_search_reads_only_suspicious_columns(spark):
    df = spark.range(2000).selectExpr("id", "IF(id = 5, 1e6, id % 10 + 1.0) AS x", "CAST(id % 3 AS STRING) AS t")
    rows = Q.outlier_statistics({"t": df}).collect()
    assert [(r["column"], r["outliers"], r["p95"]) for r in rows] == [("x", 1, 10.0)]
    assert [s.name for s in column_sites({"t": df})["t"]] == ["id", "x", "t"]
