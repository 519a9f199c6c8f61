import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import profile_tables
from plumbline.functions import pii
from plumbline.operators import findings as FD
from plumbline.operators import fixes as FX
from plumbline.operators import redaction
from plumbline.operators.profile import top_values
from plumbline.plans import report as RP
from plumbline.plans.audit import audit
from tests.samples import clean_orders, sales


@pytest.fixture()
def tiny(spark):
    return {"t": spark.createDataFrame([(1, "foo"), (2, "bar"), (3, None)], "id int, val string")}


def finding(code="C", risk="green", fix=("set", "val", "val IS NULL", "'x'"), kind="quality", severity="high", column="val"):
    # column order of FD.SCHEMA
    return (kind, code, ["t"], column, severity, risk, code, {"n": 1.0}, fix, "val IS NULL", None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FD.SCHEMA)


BROKEN = ("set", "val", "missing = 1", "'x'")


def test_dry_run_counts_matches_and_leaves_the_table(tiny):
    ok, broken, late, wrong_column, no_table = FX.dry_run(
        tiny,
        [
            FX.Fix("t", "val", "val IS NULL OR id = 1", "'foo'"),
            FX.Fix("t", "val", "missing = 1", "'x'"),
            FX.Fix("t", "val", "id = 2", "raise_error('boom')"),
            FX.Fix("t", "nope", "id = 2", "'x'"),
            FX.Fix("u", "val", "id = 2", "'x'"),
        ],
    )
    assert (ok.passed, ok.estimated_rows_affected, ok.disposition) == (True, 2, "keep")
    for failed in (broken, late, wrong_column, no_table):
        assert (failed.passed, failed.estimated_rows_affected, failed.disposition) == (False, None, "drop")
        assert failed.error
    assert tiny["t"].where("val IS NULL").count() == 1


def test_dispositions(spark, tiny):
    rows = [
        finding("good"),
        finding("green_bad", fix=BROKEN),
        finding("yellow_bad", "yellow", BROKEN),
        finding("red", "red", BROKEN),
        finding("none", "green", None),
        finding("enrich_bad", "green", BROKEN, kind="enrichment"),
    ]
    done, fixes, outcomes = FX.validate(tiny, frame(spark, *rows))
    got = {r["code"]: r for r in done.collect()}
    assert got["good"]["dry_run"]["passed"] and got["good"]["dry_run"]["estimated_rows_affected"] == 1
    assert got["good"]["fix"] is not None
    assert (got["green_bad"]["fix_risk"], got["green_bad"]["fix"]) == ("yellow", None)
    assert (got["yellow_bad"]["fix_risk"], got["yellow_bad"]["fix"]) == ("yellow", None)
    assert got["red"]["dry_run"] is None and got["red"]["fix_risk"] == "red"
    assert got["none"]["dry_run"] is None and got["none"]["fix_risk"] == "green"
    assert (got["enrich_bad"]["fix_risk"], got["enrich_bad"]["fix"]) == ("green", None)
    assert [f.risk for f in fixes] == ["green", "green", "yellow", "green"] and len(outcomes) == 4


def test_fixes_apply_in_order(tiny):
    fixes = [
        FX.Fix("t", "val", "val IS NULL", "'bar'"),
        FX.Fix("t", "val", "val = 'bar'", "'baz'"),
        FX.Fix("t", "id", "id = 1", action="drop_rows"),
        FX.Fix("t", "val", "id = 2", "'never'", risk="yellow"),
        FX.Fix("t", "val", "missing = 1", "'x'"),
    ]
    out = FX.apply_fixes(tiny["t"], "t", fixes, FX.dry_run(tiny, fixes))
    assert sorted(map(tuple, out.collect())) == [(2, "baz"), (3, "baz")]
    assert out.schema == tiny["t"].schema


def test_rows_of_unknown_predicate_are_kept(tiny):
    fix = FX.Fix("t", "val", "val <> 'foo'", action="drop_rows")
    assert sorted(r["id"] for r in fix.apply(tiny["t"]).collect()) == [1, 3]


def test_red_gate(spark):
    rows = spark.range(1).select(F.lit("t").alias("table"), F.lit("c").alias("column"))
    made = [
        FD.finding("X", "low", risk, "d", {"n": F.lit(1)}, fix=FD.drop_rows("c", "c IS NULL")) for risk in ("red", "green")
    ]
    assert [r["fix"] is None for r in FD.emit(rows, *made).collect()] == [True, False]


def test_summary_and_counts(spark):
    rows = [finding(f"c{i}", severity="critical") for i in range(1)]
    rows += [finding(f"h{i}", severity="high") for i in range(2)]
    rows += [finding(f"e{i}", kind="enrichment", severity="low") for i in range(8)]
    row = RP.summary(frame(spark, *rows)).first()
    assert (row["health_score"], row["band"]) == (100 - 15 - 16 - 5, "Fair")
    assert (row["critical_count"], row["high_count"], row["medium_count"], row["low_count"]) == (1, 2, 0, 8)
    assert row["summary"] == "Quality findings: 3 (critical 1, high 2). Enrichment findings: 8."
    assert [tuple(r) for r in RP.severity_counts(frame(spark, *rows)).collect()] == [
        ("critical", 1), ("high", 2), ("medium", 0), ("low", 8),
    ]


@pytest.mark.parametrize("n, score, band", [(0, 100, "Good"), (7, 0, "Poor")])
def test_score_bounds(spark, n, score, band):
    row = RP.summary(frame(spark, *[finding(f"c{i}", severity="critical") for i in range(n)])).first()
    assert (row["health_score"], row["band"]) == (score, band)


def test_report_tables(spark):
    rows = frame(
        spark,
        finding("g", "green"), finding("y", "yellow", severity="low"), finding("r", "red", None, severity="critical"),
        finding("re", "red", None, kind="enrichment"), finding("ge", "green", kind="enrichment"),
        finding("unfixed", "green", None),
    )
    steps = [(r["phase"], r["step"], r["code"]) for r in RP.runbook(rows).collect()]
    assert steps == [(1, 1, "g"), (1, 2, "ge"), (2, 1, "y"), (3, 1, "r")]
    table = [(r["kind"], r["severity"], r["number"], r["code"]) for r in RP.findings_table(rows).collect()]
    assert table == [
        ("quality", "critical", 1, "r"), ("quality", "high", 1, "g"), ("quality", "high", 2, "unfixed"),
        ("quality", "low", 1, "y"), ("enrichment", "high", 1, "ge"), ("enrichment", "high", 2, "re"),
    ]
    assert RP.selected_fixes(rows).count() == 2
    assert tuple(RP.scope(rows, "csv").first()) == ("CSV", "t")
    assert RP.as_json(rows).count() == 6
    moment = spark.range(1).select(RP.generated_at(F.lit(dt.datetime(2024, 5, 6, 7, 8)))).first()[0]
    assert moment == "2024-05-06 07:08 UTC"


def test_empty_report(spark):
    none = frame(spark)
    assert RP.runbook(none).count() == 0 and RP.findings_table(none).count() == 0
    assert tuple(RP.scope(none, "csv").first()) == ("CSV", "")


def test_redaction(spark):
    text = "mail a.b@c.org, card 4111 1111 1111 1111, ssn 123-45-6789, ip 10.0.0.1, call +1 555 010 9999"
    rows = [(text,), ("see https://x.y/z and GB82WEST12345698765432",), ("  ",), (None,), ("plain",)]
    df = spark.createDataFrame(rows, "v string")
    got = [r["v"] for r in redaction.redact_columns(df, ["v"]).collect()]
    assert got == [
        "mail [REDACTED:EMAIL_ADDRESS], card [REDACTED:CREDIT_CARD], ssn [REDACTED:US_SSN], "
        "ip [REDACTED:IP_ADDRESS], call [REDACTED:PHONE_NUMBER]",
        "see [REDACTED:URL] and GB82WEST[REDACTED:PHONE_NUMBER]",
        "  ", None, "plain",
    ]
    counts = {r["entity"]: (r["hits"], r["rows"]) for r in redaction.entity_report(df, ["v"]).collect()}
    assert counts["EMAIL_ADDRESS"] == (1, 1) and counts["PHONE_NUMBER"] == (2, 2) and counts["URL"] == (1, 1)
    only = spark.createDataFrame([("AB12CDEFGHIJKLMN",)], "v string").select(pii.redact(F.col("v"))).first()[0]
    assert only == "[REDACTED:IBAN_CODE]"


def test_redacted_profile(spark):
    profile = profile_tables({"t": spark.createDataFrame([("a@b.org",), ("a@b.org",), (None,)], "v string")})
    row = redaction.redact_profile(profile).first()
    assert row["min_val"] == "[REDACTED:EMAIL_ADDRESS]"
    assert (row["top_values"][0]["value"], row["top_values"][0]["count"]) == ("[REDACTED:EMAIL_ADDRESS]", 2)
    kept = redaction.redact_profile(profile, extremes=False)
    assert kept.first()["min_val"] == "a@b.org"
    assert top_values(kept).first()["value"] == "[REDACTED:EMAIL_ADDRESS]"


def test_audit_of_a_sheet(spark):
    done = audit({"sales": sales(spark)}, enrich=False)
    summary = done.summary.first()
    assert summary["health_score"] == 100 - 15 - 8 - 3 * 3 - 1 * 2
    dates = done.findings.where("`column` = 'order_date'").first()
    assert dates["dry_run"]["passed"] and dates["dry_run"]["estimated_rows_affected"] == 1
    fixed = done.cleaned["sales"].where("order_id = 'ORD-010'").first()
    assert fixed["order_date"] == "2024-01-20"
    assert done.cleaned["sales"].count() == 50
    assert done.runbook.where("phase = 1").count() == 1


def test_audit_of_a_clean_table(spark):
    done = audit({"orders": clean_orders(spark)})
    assert done.findings.where("kind = 'quality'").count() == 0
    assert done.summary.first()["health_score"] == 95
