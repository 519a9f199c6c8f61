import numpy as np
from pyspark.sql import functions as F

from plumbline import profile_tables
from plumbline.operators import enrichment as E
from plumbline.operators import products
from plumbline.sources.settle import settle
from tests.samples import clean_orders


def table(spark, n=6000):
    return spark.range(n).selectExpr(
        "id AS row_no", "id % 7 + 1 AS a", "CAST(id % 11 AS DOUBLE) + 0.5 AS b",
        "(id % 7 + 1) * (id % 11 + 0.5) AS product",
        # right on the probe rows, wrong once far behind them
        "IF(id = 5500, 0, (id % 7 + 1) * (id % 11 + 0.5)) AS almost",
        "id % 7 + 1 AS copy", "IF(id = 5501, NULL, id % 7 + 1) AS near_copy",
        "CAST(id % 7 AS STRING) AS code", "IF(id = 5502, 'other', concat('n', id % 7)) AS near_name",
        "'x' AS same",
    )


def test_products_are_confirmed_on_all_rows(spark):
    rows = E.derivable_columns(table(spark), ["same"]).collect()
    targets = {r["target"] for r in rows}
    assert "product" in targets and "almost" not in targets
    assert all(r["checked"] <= 6000 for r in rows)


def test_copies_compare_nulls(spark):
    pairs = {(r["kept"], r["copy"]) for r in E.redundant_pairs(table(spark)).collect()}
    assert pairs == {("a", "copy")}


def test_dependencies(spark):
    got = E.dependencies(table(spark), ["a", "code"], ["code", "near_name", "b", "near_copy"]).collect()
    assert {(r["determinant"], r["dependent"], r["values"]) for r in got} == {
        ("a", "code", 7), ("a", "near_copy", 7), ("code", "near_copy", 7),
    }


def test_late_columns_are_claimed_without_listing_all_triples(spark):
    """300 numeric columns; a third of them is empty in the first rows, another third elsewhere."""
    early = [f"CAST(abs(hash(id, {i})) % 1000003 AS DOUBLE) + 0.25 AS e{i}" for i in range(100)]
    late = [f"IF(id >= 2000, abs(hash(id, 7, {i})) % 99991 + 0.5, NULL) AS l{i}" for i in range(98)]
    other = [f"IF(id < 2500, abs(hash(id, 9, {i})) % 99989 + 0.5, NULL) AS o{i}" for i in range(100)]
    df = spark.range(3000).selectExpr("id", *early, *late, *other)
    df = df.selectExpr("*", "l3 * l4 AS made", "IF(id = 2999, 1, l3 * e5) AS nearly")
    rows = E.derivable_columns(df, ["id"]).collect()
    assert [tuple(r) for r in rows] == [("made", "l3", "l4", 1000)]


def test_products_that_rows_let_stand():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = rng.integers(-3, 4, (rng.integers(1, 6), 6)).astype(float)
        rows[rng.random(rows.shape) < 0.3] = np.nan
        gaps = {(c, a, b): np.abs(rows[:, c] - rows[:, a] * rows[:, b]) for c in range(6) for a in range(6) for b in range(a + 1, 6) if c not in (a, b)}
        tested = {claim: g[~np.isnan(g)] for claim, g in gaps.items()}
        assert sorted(products.surviving(rows, 0.005)) == sorted(c for c, g in tested.items() if len(g) and (g <= 0.005).all())
        assert sorted(products.unseen(rows)) == sorted(c for c, g in tested.items() if not len(g))
    assert products.surviving(np.empty((0, 4)), 0.005) == []


def test_products_beyond_the_sets_of_columns_that_are_sampled(spark):
    """More sets of filled columns than rows are taken for: what no row tested is checked on the table."""
    df = spark.range(4000).selectExpr(
        "id", *[f"IF(id >> {i} & 1 = 1, hash(id, {i}) % 97 + 0.5, NULL) AS v{i}" for i in range(5)]
    ).selectExpr("*", "v0 * v3 AS made")
    few = E.Options(probe_rows=2)
    assert {(r["target"], r["left"], r["right"]) for r in E.derivable_columns(df, ["id"], few).collect()} == {("made", "v0", "v3")}


def test_fingerprints_of_all_columns_in_one_pass(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS a", "id % 3 AS b", "IF(id = 499, 5, id % 3) AS c", "IF(id % 3 = 0, NULL, id) AS d", "IF(id % 3 = 0, NULL, id) AS e", "0.0D * (id - 250) AS z", "0.0D AS zero")
    pairs = {(r["kept"], r["copy"]) for r in E.redundant_pairs(df.repartition(7)).collect()}
    assert pairs == {("a", "b"), ("d", "e"), ("z", "zero")}
    assert E.redundant_pairs(df.limit(0)).count() == 0


def test_dependencies_against_brute_force(spark):
    rng = np.random.default_rng(2)
    names = [f"v{i}" for i in range(6)]
    rows = [[None if rng.random() < 0.2 else int(x) for x in rng.integers(0, k, 4)] for k in (2, 3, 9) for _ in range(12)]
    rows = [(*r, None if r[0] is None else r[0] * 2, None) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    expected = set()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            pairs = {(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None}
            if a != b and pairs and len(pairs) == len({x for x, _ in pairs}):
                expected.add((a, b, len(pairs)))
    got = E.dependencies(df, names, names, width=4)
    assert {tuple(r) for r in got.collect()} == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 4  # of two blocks of dependents: a row per determinant, and the verdicts


def test_no_claims_no_rows(spark):
    df = spark.createDataFrame([("a",)], "v string")
    assert E.derivable_columns(df).count() == 0
    assert E.redundant_pairs(df).count() == 0
    assert E.dependencies(df, ["v"], ["v"]).count() == 0


def test_clean_orders_have_opportunities(spark):
    tables = {"orders": clean_orders(spark)}
    findings = settle(E.enrichment_findings(tables, settle(profile_tables(tables))))
    codes = {(r["code"], r["column"]) for r in findings.collect()}
    assert ("DERIVABLE_COLUMN", "total_price") in codes
    assert ("NORMALIZATION_OPPORTUNITY", "customer_name") in codes
    assert ("MISSING_CONSTRAINT", "order_id") in codes
    best = E.best(findings).collect()
    assert len(best) == 5 and {r["severity"] for r in best} == {"medium"}
    assert all(r["fix"] is None for r in best)


def test_profile_rules(spark):
    df = spark.range(5000).select(
        F.current_date().alias("day"), (F.col("id") % 4).alias("part"), F.lit(1).alias("one"), F.col("id").alias("key")
    )
    schema = spark.createDataFrame(
        [("t", c, c != "part") for c in df.columns], "`table` string, `column` string, nullable boolean"
    )
    rows = E.profile_findings(profile_tables({"t": df}), schema, E.Options(partition_rows=5000)).collect()
    got = {(r["code"], r["column"], r["severity"]) for r in rows}
    assert ("PARTITION_OPPORTUNITY", "part", "low") in got and ("PARTITION_OPPORTUNITY", "day", "low") in got
    assert ("REDUNDANT_COLUMN", "one", "low") in got and ("MISSING_CONSTRAINT", "key", "medium") in got
    assert ("MISSING_CONSTRAINT", "part", "low") not in got


def test_what_some_rows_refute_does_not_travel(spark):
    """Rows meet the groups of a determinant with the hashes of those columns only that it may determine."""
    made = [f"id % {k} AS v{i}" for i, k in enumerate((500, 499, 491, 487, 479, 467, 463))]
    df = spark.range(30_000).selectExpr(*made, "'x' AS same", "id % 500 * 0.5D AS half", "IF(id = 29999, 1, id % 499) AS nearly")
    names = df.columns
    got = E.dependencies(df, names, names)
    held = {(a, "same", int(a[1:]) and k or 500) for a, k in zip(names, (500, 499, 491, 487, 479, 467, 463), strict=False)}
    held |= {("half", "same", 500), ("nearly", "same", 499), ("v0", "half", 500), ("half", "v0", 500)}
    assert {tuple(r) for r in got.collect()} == held
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(") <= 3 and plan.count("Generate") == 2  # ten columns: one hash each before


def test_values_that_stand_for_themselves(spark):
    """Both zeros, not-a-number and the ends of the types are values of their own, as their texts are."""
    rows = [(0.0, 1, 2**63 - 1, True), (-0.0, 2, -(2**63), False), (float("nan"), 3, 0, None), (float("inf"), 4, -1, True), (1.5, 5, 1, False)]
    df = spark.createDataFrame(rows * 3, "f double, i int, b bigint, t boolean").selectExpr("*", "CAST(f AS FLOAT) AS g", "CAST(f AS STRING) AS s", "date_add(DATE'2020-01-01', i) AS d")
    names, shown = df.columns, df.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in df.columns])
    got = {tuple(r) for r in E.dependencies(df, names, names).collect()}
    assert got == {tuple(r) for r in E.dependencies(shown, names, names).collect()}
    assert ("f", "i", 5) in got and ("i", "t", 4) in got and ("t", "i", 2) not in got


def test_refuting_rows_do_not_depend_on_their_order(spark):
    df = spark.range(4000).selectExpr("id AS a", "id % 40 AS b", "IF(id = 3999, 7, id % 40 % 5) AS c")
    few = E.Options(probe_values=2, probe_share=3)
    expected = {("a", "b", 4000), ("a", "c", 4000)}
    for rows in (df, df.orderBy(F.desc("a")), df.repartition(5, "c")):
        assert {tuple(r) for r in E.dependencies(rows, df.columns, df.columns, few).collect()} == expected
