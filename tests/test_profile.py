import datetime as dt
import math
import random
import statistics
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import ProfileOptions, profile_table, profile_tables
from plumbline.functions.types import canonical_type, catalog_label
from plumbline.operators import profile as P


def by_column(profile):
    return {r["column"]: r for r in profile.collect()}


def values(row):
    return [(v["value"], v["count"]) for v in row["top_values"]]


def test_low_cardinality_with_nulls(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 50, F.concat(F.lit("s"), F.col("id") % 4)).alias("status"))
    row = by_column(profile_table("t", df))["status"]
    assert (row["row_count"], row["null_count"], row["distinct_count"]) == (1000, 50, 4)
    assert row["null_pct"] == 0.05
    assert row["pattern_flags"] == ["possible_enum"]


def test_null_flags_exclude_each_other(spark):
    df = spark.range(100).selectExpr(
        "CAST(NULL AS STRING) AS none",
        "CASE WHEN id >= 60 THEN id % 5 END AS few",
        "CASE WHEN id >= 25 THEN id END AS most",
    )
    rows = by_column(profile_table("t", df))
    assert rows["none"]["pattern_flags"] == ["all_null"]
    assert rows["none"]["top_values"] == [] and rows["none"]["inferred_type"] == "string"
    assert rows["few"]["pattern_flags"] == ["high_null_critical"]
    assert rows["most"]["pattern_flags"] == ["high_null", "near_unique"]


@pytest.mark.parametrize(
    "texts, inferred",
    [
        (["12.50", "3.99", "7"], "float"),
        (["1", "-20", "300"], "integer"),
        (["0", "1"], "integer"),
        (["yes", "NO"], "boolean"),
        (["2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05 10:00:00.123+02:00"], "date"),
        (["1e5", "-2.5E-3"], "float"),
        (["12", "x"], "string"),
        (["12\n"], "string"),
        ([None], "string"),
    ],
)
def test_inference(spark, texts, inferred):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert by_column(profile_table("t", df))["v"]["inferred_type"] == inferred


def test_mixed_types_counts_empty_text_as_not_numeric(spark):
    df = spark.createDataFrame([("1",), ("",)], "v string")
    assert "mixed_types" in by_column(profile_table("t", df))["v"]["pattern_flags"]


def test_expected_type_enables_mismatch(spark):
    df = spark.createDataFrame([("1",), ("2",)], "v string")
    rows = by_column(profile_tables({"t": df}, expected_types={"t": {"v": "VARCHAR"}}))
    assert rows["v"]["inferred_type"] == "integer"
    assert "type_mismatch" in rows["v"]["pattern_flags"]


def test_text_extremes_are_lexicographic(spark):
    df = spark.createDataFrame([(9,), (10,), (-3,)], "v int")
    row = by_column(profile_table("t", df))["v"]
    assert (row["min_val"], row["max_val"]) == ("-3", "9")


def test_odd_names_and_types(spark):
    schema = T.StructType(
        [
            T.StructField("a.b", T.IntegerType()),
            T.StructField("tick`s", T.StringType()),
            T.StructField("it's \\ odd", T.BooleanType()),
            T.StructField("list", T.ArrayType(T.IntegerType())),
            T.StructField("map", T.MapType(T.StringType(), T.IntegerType())),
            T.StructField("money", T.DecimalType(10, 2)),
            T.StructField("day", T.DateType()),
            T.StructField("raw", T.BinaryType()),
            T.StructField("small", T.ByteType()),
        ]
    )
    data = [
        (1, "x", True, [1, 2], {"k": 1}, Decimal("5.00"), dt.date(2024, 1, 1), b"ab", 3),
        (2, "x", False, [1, 2], {"k": 2}, Decimal("5.00"), dt.date(2024, 1, 2), b"ab", 3),
    ]
    rows = by_column(profile_table("o'hara", spark.createDataFrame(data, schema)))
    assert list(sorted(rows)) == sorted(schema.names)
    assert rows["a.b"]["table"] == "o'hara"
    assert values(rows["list"]) == [("[1,2]", 2)]
    assert values(rows["map"]) == [('{"k":1}', 1), ('{"k":2}', 1)]
    assert values(rows["money"]) == [("5.00", 2)] and rows["money"]["mean_val"] == 5.0
    assert rows["day"]["min_val"] == "2024-01-01" and rows["day"]["mean_val"] is None
    assert rows["it's \\ odd"]["mean_val"] == 0.5
    assert rows["small"]["declared_type"] == "string" and rows["small"]["mean_val"] == 3.0


def test_empty_table_and_single_row(spark):
    empty = spark.createDataFrame([], "a int, b string")
    one = spark.createDataFrame([(5, "z")], "a int, b string")
    rows = {(r["table"], r["column"]): r for r in profile_tables({"empty": empty, "one": one}).collect()}
    a = rows["empty", "a"]
    assert (a["row_count"], a["null_count"], a["null_pct"], a["cardinality_ratio"]) == (0, 0, 0.0, 0.0)
    assert a["pattern_flags"] == [] and a["min_val"] is None
    assert rows["one", "a"]["std_val"] is None and rows["one", "a"]["mean_val"] == 5.0


def test_numbers_that_are_not_finite_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (math.inf,), (math.nan,)], "v double")
    row = by_column(profile_table("t", df))["v"]
    assert row["mean_val"] == 2.0 and row["distinct_count"] == 4


@pytest.mark.parametrize("rule, mean", [("lenient", 10.0 + 5.5 / 5), ("plain", 9.25)])
def test_number_rules(spark, rule, mean):
    texts = ["12", "6.5", " 3 ", "+4", "3e1", "12d", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    row = by_column(profile_table("t", df, ProfileOptions(number_rule=rule)))["v"]
    assert row["mean_val"] == pytest.approx(mean)


def test_long_texts_stay_whole_and_distinct(spark):
    shared = "x" * 500
    texts = [shared + "a"] * 3 + [shared + "b"] * 2 + [shared[:128]] + ["short"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    row = by_column(profile_table("t", df))["v"]
    assert row["distinct_count"] == 4
    assert values(row) == [(shared + "a", 3), (shared + "b", 2), ("short", 1), (shared[:128], 1)]
    assert row["max_val"] == shared + "b"


def test_shares_of_all_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    shares = {
        base: [v["pct"] for v in by_column(profile_table("t", df, ProfileOptions(pct_base=base)))["v"]["top_values"]]
        for base in ("non_null", "all")
    }
    assert shares["all"] == [50.0, 25.0]
    assert shares["non_null"] == pytest.approx([200 / 3, 100 / 3])


def test_against_brute_force_with_a_hot_value(spark):
    rng = random.Random(7)
    rows = [
        (
            1 if rng.random() < 0.34 else rng.randrange(500),
            None if rng.random() < 0.1 else rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice([1, 200]),
            rng.gauss(0, 50),
        )
        for _ in range(4000)
    ]
    df = spark.createDataFrame(rows, "n int, t string, x double").repartition(7)
    got = by_column(profile_table("t", df))
    for i, name in enumerate(("n", "t", "x")):
        known = [r[i] for r in rows if r[i] is not None]
        counts = Counter(known)
        assert got[name]["distinct_count"] == len(counts)
        assert got[name]["null_count"] == len(rows) - len(known)
        assert sorted((v["count"] for v in got[name]["top_values"]), reverse=True) == [
            c for _, c in counts.most_common(20)
        ]
        for v in got[name]["top_values"]:
            value = v["value"] if name == "t" else type(known[0])(v["value"])
            assert counts[value] == v["count"]
        shown = sorted(str(v) for v in counts) if name != "x" else None
        if shown:
            assert (got[name]["min_val"], got[name]["max_val"]) == (shown[0], shown[-1])
    xs = [r[2] for r in rows]
    assert got["x"]["mean_val"] == pytest.approx(statistics.fmean(xs))
    assert got["x"]["std_val"] == pytest.approx(statistics.stdev(xs))


def test_wide_table_uses_several_aggregates(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"k{i}") for i in range(9)])
    rows = by_column(profile_table("t", df, ProfileOptions(stats_width=4)))
    assert [rows[f"k{i}"]["mean_val"] for i in range(9)] == [4.5 * i for i in range(9)]


def test_values_are_shuffled_once(spark, tmp_path):
    spark.range(5000).selectExpr("id", "CAST(id % 9 AS STRING) AS label", "id * 0.5 AS half").write.parquet(
        str(tmp_path / "t")
    )
    tables = {"t": spark.read.parquet(str(tmp_path / "t"))}
    sites = P.column_sites(tables)
    head = P.frequency_head(P.value_frequencies(tables, sites), 20)
    head.collect()
    profile = profile_tables(tables)
    profile.collect()
    plans = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df in (head, profile)]
    assert "ReusedExchange" in plans[0]
    # two reads per column: three slots here, typed and text statistics there
    assert [plan.count("FileScan parquet [id") + plan.count("FileScan parquet [la") + plan.count("FileScan parquet [ha") for plan in plans] == [3, 2]
    for plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
        assert "ReadSchema: struct<label:string>" in plan  # each read takes only its columns


def whole_order(texts, k):
    return sorted(Counter(texts).items(), key=lambda item: (-item[1], item[0].encode()))[:k]


@pytest.mark.parametrize("shared", ["", "x" * 200, "é" * 128, "y" * 2000, "z" * 127])
def test_long_ties_follow_whole_values(spark, shared):
    """Many texts of one beginning; the border of the leading values lies among them."""
    rng = random.Random(len(shared))
    texts = [shared + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) + rng.choice(["", "q" * 700]) for _ in range(300)]
    texts += [shared + "a" * n for n in range(130)] + ["b" * 300] * 3 + ["short"] * 2
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "v string, n int").repartition(5)
    for k in (1, 5, 20, 64):
        row = by_column(profile_table("t", df, ProfileOptions(top_k=k)))["v"]
        assert values(row) == whole_order(texts, k)


def test_the_descent_reads_only_columns_whose_border_ties(spark):
    data = [("p" * 500 + str(i), "q" * 300 if i < 30 else "r" * 300 + str(i), "s") for i in range(60)]
    df = spark.createDataFrame(data, "tied string, clear string, brief string")
    tables, asked = {"t": df}, []
    sites, options = P.column_sites(tables), ProfileOptions(top_k=1)

    def texts(cids):
        asked.append(sorted(cids))
        return P.long_texts(tables, sites, cids, options.inline_chars)

    head = P.frequency_head(P.value_frequencies(tables, sites, options), 1)
    rows = P.long_ties.in_value_order(head, 1, options.inline_chars, texts).collect()
    assert asked == [[0], [0, 1]]  # one level for the tie, then the winners' texts
    assert {r["cid"]: r["value"] for r in rows} == {0: "p" * 500 + "0", 1: "q" * 300, 2: "s"}


def test_presentation(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    profile = profile_table("t", df)
    assert P.rounded(profile).first()["null_pct"] == 0.3333
    assert [(r["rank"], r["value"]) for r in P.top_values(profile).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert P.table_shapes(profile).collect() == [("t", 3, 1)]


def test_canonical_types(spark):
    assert [canonical_type(t) for t in (T.LongType(), T.ByteType(), T.DecimalType(5, 1), T.DateType())] == [
        "integer", "string", "float", "date",
    ]
    names = spark.createDataFrame([("DECIMAL(10,2)",), ("timestamp with time zone",), ("JSON",), ("TINYINT",)], "n string")
    assert [r[0] for r in names.select(catalog_label(F.col("n"))).collect()] == ["float", "datetime", "string", "string"]


def test_options_are_checked():
    with pytest.raises(ValueError):
        ProfileOptions(deviation="other")
    with pytest.raises(ValueError):
        ProfileOptions(pct_base="other")
