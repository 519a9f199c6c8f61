"""Columns that cannot be read, label spellings, fixes that fail in a chain, composite keys."""

import pytest
from pyspark.sql import functions as F

from plumbline import profile_tables
from plumbline.operators import fixes as FX
from plumbline.operators import inquiries, isolation, profile as P, quality as Q
from plumbline.plans.audit import audit
from plumbline.sources import catalog


def broken(spark, n=200):
    """Two columns whose values raise an error far from the first row."""
    return spark.range(n).selectExpr(
        "id", "id % 5 AS five", "CAST(IF(id = 150, 'x', '1') AS INT) AS bad", "concat('t', id % 3) AS text",
        "100 / (id - 177) AS worse", "id * 2 AS twice", "CAST(id % 2 = 0 AS BOOLEAN) AS even",
    )


def test_failing_columns_are_found_and_the_others_profiled(spark, monkeypatch):
    tables = {"fine": spark.range(10).selectExpr("id AS k"), "broken": broken(spark)}
    runs, whole = [], isolation._profile_of
    monkeypatch.setattr(isolation, "_profile_of", lambda t, sites, o: runs.append(len(sites)) or whole(t, sites, o))
    profile, failures = isolation.profile_isolated(tables)
    assert {(r["table"], r["column"]) for r in failures.collect()} == {("broken", "bad"), ("broken", "worse")}
    assert all(r["error"] for r in failures.collect())
    good = {name: df.drop("bad", "worse") for name, df in tables.items()}
    places = {"id": 0, "five": 1, "text": 3, "twice": 5, "even": 6, "k": 0}
    expected = {r["column"]: r.asDict() | {"ordinal": places[r["column"]]} for r in profile_tables(good).collect()}
    assert {r["column"]: r.asDict() for r in profile.select(*P.PROFILE_COLUMNS).collect()} == expected
    assert len(runs) <= 1 + 2 * 2 * 4  # two culprits among eight columns


def test_tables_that_cannot_be_read(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "gone"))
    gone = spark.read.parquet(str(tmp_path / "gone"))
    for file in (tmp_path / "gone").glob("*.parquet"):
        file.unlink()
    profile, failures = isolation.profile_isolated({"gone": gone, "here": spark.range(3)})
    assert [(r["table"], r["column"]) for r in failures.collect()] == [("gone", None)]
    assert [r["table"] for r in profile.collect()] == ["here"]
    assert list(isolation.readable_columns({"gone": gone, "here": spark.range(3)}, failures)) == ["here"]


def test_audit_goes_on_without_unreadable_columns(spark):
    done = audit({"broken": broken(spark)}, enrich=False)
    assert {r["column"] for r in done.unreadable.collect()} == {"bad", "worse"}
    assert {r["column"] for r in done.profile.collect()} == {"id", "five", "text", "twice", "even"}
    assert done.cleaned["broken"].count() == 200


def test_labels_take_their_usual_spelling_and_others_stay(spark):
    labels = ["HR"] * 5 + ["hr"] * 2 + [" HR"] + ["Finance"] * 4 + ["it's \\ odd"] * 3 + ["IT'S \\ ODD"] + ["b", "B"] + [None]
    df = spark.createDataFrame([(x,) for x in labels * 20], "team string")
    found = Q.label_findings({"t": df}, [("t", "team")]).collect()
    assert len(found) == 1 and found[0]["evidence"] == {"labels": 3.0, "spellings": 7.0, "rows": 280.0}
    fix = found[0]["fix"]
    run = FX.Fix("t", "team", fix["predicate"], fix["value"])
    assert FX.dry_run({"t": df}, [run])[0].estimated_rows_affected == 100
    after = {r["team"]: r["count"] for r in run.apply(df).groupBy("team").count().collect()}
    assert after == {"HR": 160, "Finance": 80, "it's \\ odd": 80, "B": 40, None: 20}
    assert df.where(F.expr(found[0]["investigation"])).count() == 100


def test_too_many_or_long_spellings_get_no_fix(spark):
    many = spark.range(1200).selectExpr("IF(id % 2 = 0, concat('a', id), concat('A', id - 1)) AS v")
    long = spark.range(40).selectExpr("IF(id % 2 = 0, repeat('x', 300), repeat('X', 300)) AS v")
    found = {r["tables"][0]: r for r in Q.label_findings({"many": many, "long": long}, [("many", "v"), ("long", "v")]).collect()}
    assert set(found) == {"many", "long"} and all(r["fix"] is None and r["investigation"] for r in found.values())


def test_culprits_of_a_chain_take_a_pass_each(spark, monkeypatch):
    df = spark.range(100).selectExpr("CAST(id AS SMALLINT) AS n", "CAST(id AS STRING) AS s")
    fixes = [FX.Fix("t", "n", f"n = {i}", f"n + {i}") for i in range(1, 6)]
    fixes.append(FX.Fix("t", "s", "n = 8", "'many'"))
    fixes.append(FX.Fix("t", "n", "s = 'many'", "n + 60000"))  # only after the one before
    fixes += [FX.Fix("t", "n", f"n = {i}", "n") for i in (20, 21)]
    fixes.append(FX.Fix("t", "n", "CAST(replace(s, 'many', 'x') AS INT) = 7", "1"))  # raises after it
    runs, whole = [], FX._losses
    monkeypatch.setattr(FX, "_losses", lambda d, f, c: runs.append(len(c)) or whole(d, f, c))
    outcomes = FX.dry_run({"t": df}, fixes)
    assert [o.passed for o in outcomes] == [True] * 6 + [False, True, True, False]
    assert len(runs) <= 7
    runs.clear()
    assert [o.passed for o in FX.dry_run({"t": df}, fixes[:-1])] == [True] * 6 + [False, True, True]
    assert len(runs) == 2  # one culprit, and the chain without it
    assert FX.apply_fixes(df, "t", fixes, outcomes).count() == 100


@pytest.fixture(scope="module")
def ansi(spark):
    constraints = [("fk_line", "public", "lines", "FOREIGN KEY"), ("fk_line", "public", "notes", "FOREIGN KEY"), ("pk_order", "public", "orders", "PRIMARY KEY")]
    usage = [
        ("fk_line", "public", "lines", "order_no", 1, 2),
        ("fk_line", "public", "lines", "branch", 2, 1),
        ("fk_line", "public", "notes", "b", 1, 1),
        ("fk_line", "public", "notes", "o", 2, 2),
        ("pk_order", "public", "orders", "branch_id", 1, None),
        ("pk_order", "public", "orders", "id", 2, None),
    ]
    references = [("fk_line", "public", "pk_order", "public")]
    return (
        spark.createDataFrame(constraints, "constraint_name string, table_schema string, table_name string, constraint_type string"),
        spark.createDataFrame(usage, "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"),
        spark.createDataFrame(references, "constraint_name string, constraint_schema string, unique_constraint_name string, unique_constraint_schema string"),
    )


def test_composite_keys_meet_by_position(ansi):
    constraints, usage, references = ansi
    got = catalog.declared_keys_ansi(constraints, usage, references=references)
    assert {tuple(r) for r in got.collect()} == {
        ("lines", "order_no", "orders", "id"), ("lines", "branch", "orders", "branch_id"),
        ("notes", "b", "orders", "branch_id"), ("notes", "o", "orders", "id"),
    }
    with pytest.raises(ValueError):
        catalog.declared_keys_ansi(constraints, usage)


def test_rows_behind_findings_over_groups(spark):
    rows = [(1, "a", 10, b"x"), (1, "b", 11, None), (2, "a", 10, b"x"), (3, None, None, None), (4, None, None, None), (None, "z", 12, b"y"), (None, "y", 13, b"y")]
    df = spark.createDataFrame(rows, "id int, t string, parent int, raw binary")
    parents = spark.createDataFrame([(10,), (13,)], "id int")
    relation = {"from_table": "t", "from_column": "parent", "to_table": "p", "to_column": "id"}
    base = {"kind": "quality", "tables": ["t"], "column": None, "investigation": None, "description": "Values missing from p"}

    def behind(**finding):
        return inquiries.offending_rows({"t": df, "p": parents}, base | finding, {"t": ["id"]}, [relation])

    shown = lambda found: sorted(((r["id"], r["t"]) for r in found.collect()), key=str)
    assert shown(behind(code="POSSIBLE_DUPLICATE", column="id")) == [(1, "a"), (1, "b")]
    assert shown(behind(code="POSSIBLE_DUPLICATE")) == [(1, "a"), (2, "a"), (3, None), (4, None)]
    assert shown(behind(code="CARDINALITY_ANOMALY", column="parent")) == [(1, "a"), (2, "a")]
    assert shown(behind(code="ORPHANED_FK", column="parent")) == [(1, "b"), (None, "z")]
    assert shown(behind(code="NULL_EXCESS", column="t")) == [(3, None), (4, None)]
    assert shown(behind(code="OUTLIER", column="parent", investigation="parent > 12")) == [(None, "y")]
    assert behind(code="DERIVABLE_COLUMN", kind="enrichment", column="t") is None
    assert inquiries.repeated_rows(df, df.columns).count() == 0
    clash = df.withColumnRenamed("t", "key_0")
    assert inquiries.repeated_key_rows(clash, ["id"]).columns == clash.columns
