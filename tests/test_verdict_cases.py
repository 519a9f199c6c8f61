"""Small inputs that once gave wrong results."""

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.operators.fixes import Fix, apply_fixes, dry_run
from plumbline.operators.orphans import orphan_counts, orphan_rows
from plumbline.plans.report import latest
from plumbline.sources.catalog import sample_rows


def test_date_fix_keeps_what_is_no_date(spark):
    df = spark.createDataFrame([("2024-01-01",), ("Jan 20 2024",), ("Feb 30 2024",), ("Abc 12 2024",)], "day string")
    found = quality.format_findings(quality.value_scan({"t": df})).where("column = 'day'").first()
    fix = Fix("t", "day", found["fix"]["predicate"], found["fix"]["value"])
    assert sorted(r.day for r in fix.apply(df).collect()) == ["2024-01-01", "2024-01-20", "Abc 12 2024", "Feb 30 2024"]


def test_column_of_bad_addresses_is_found(spark):
    df = spark.createDataFrame([("nobody",), ("a_at_b",)], "email string")
    assert quality.format_findings(quality.value_scan({"t": df})).count() == 1


def test_binary_rows_are_told_apart(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff")), (1, bytearray(b"\xfe")), (2, bytearray(b"a")), (2, bytearray(b"a"))], "n int, b binary")
    assert quality.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_dry_run_tests_the_stored_form(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "n int, t string")
    fixes = [Fix("t", "n", "n = 1", "'n/a'"), Fix("t", "n", "n = 1", "3000000000"), Fix("t", "n", "n = 1", "'7'"), Fix("t", "t", "t IS NULL", "5")]
    assert [o.passed for o in dry_run({"t": df}, fixes)] == [False, False, True, True]


def test_text_key_against_whole_numbers(spark):
    people = spark.createDataFrame([("1",), ("x9",), (None,), ("02",)], "nation_id string")
    nations = spark.createDataFrame([(1,), (2,)], "id int")
    counts = orphan_counts(people, ["nation_id"], nations, ["id"]).first()
    assert (counts["referring_rows"], counts["orphan_rows"], counts["orphan_values"]) == (3, 1, 1)
    assert [r.nation_id for r in orphan_rows(people, ["nation_id"], nations, ["id"]).collect()] == ["x9"]


def test_limits_are_the_callers(spark):
    rows = spark.range(120).select("id", F.lit(datetime(2024, 1, 1)).alias("created_at"))
    assert latest(rows, limit=110).count() == 110
    assert sample_rows(spark.range(60_000), 55_000).count() == 55_000


def test_fix_that_fails_only_after_another(spark):
    df = spark.createDataFrame([(1, 4.0, 0.0), (2, 6.0, 0.0)], "q int, p double, lost double")
    fixes = [
        Fix("t", "q", "q = 1", "0"),
        Fix("t", "p", "true", "1 / q"),
        Fix("t", "lost", "true", "p + 1"),
        Fix("t", "q", "q = 2", "CAST(p AS BIGINT) * 400000000 - 400000000"),
        Fix("t", "lost", "lost > 6", "q", risk="yellow"),
    ]
    outcomes = dry_run({"t": df}, fixes)
    assert [o.passed for o in outcomes] == [True, False, True, True, True]
    assert "ZERO" in outcomes[1].error
    out = apply_fixes(df, "t", fixes, outcomes)
    assert sorted(map(tuple, out.collect())) == [(0, 4.0, 5.0), (2000000000, 6.0, 7.0)]


def test_fix_whose_value_overflows_only_after_another(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    fixes = [Fix("t", "a", "a = 1", "2000000000"), Fix("t", "b", "true", "CAST(a AS BIGINT) * 2")]
    outcomes = dry_run({"t": df}, fixes)
    assert [(o.passed, o.estimated_rows_affected) for o in outcomes] == [(True, 1), (False, None)]
    assert sorted(map(tuple, apply_fixes(df, "t", fixes, outcomes).collect())) == [(3, 4), (2000000000, 2)]


def test_chain_with_dropped_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 5)], "a int, b int")
    fixes = [Fix("t", "b", "b = 0", action="drop_rows"), Fix("t", "a", "b <> 0", "10 / b")]
    outcomes = dry_run({"t": df}, fixes)
    assert [o.passed for o in outcomes] == [True, True]
    assert [tuple(r) for r in apply_fixes(df, "t", fixes, outcomes).collect()] == [(2, 5)]


def test_number_set_in_a_text_column_leaves_other_texts(spark):
    df = spark.createDataFrame([("x",), ("y",)], "t string")
    assert sorted(r.t for r in Fix("t", "t", "t = 'x'", "5").apply(df).collect()) == ["5", "y"]
