"""Report tables over findings, relations and past reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import findings as FD

# Points taken off per quality finding, and the most enrichment may take.
PENALTY = {"critical": 15, "high": 8, "medium": 3, "low": 1}
ENRICHMENT_CAP = 5
GOOD, FAIR = 80, 50


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in FD.SEVERITIES]), severity)


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, findings) for all four severities, zeros included."""
    found = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    labels = findings.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in FD.SEVERITIES])).alias("severity")
    )
    return (
        labels.join(found, "severity", "left")
        .select("severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("findings"))
        .orderBy(severity_rank(F.col("severity")))
    )


def health_band(score: Column) -> Column:
    return F.when(score >= GOOD, "Good").when(score >= FAIR, "Fair").otherwise("Poor")


def summary(findings: DataFrame) -> DataFrame:
    """One row: health score, band, counts per severity and a sentence.

    The score weighs quality findings by severity and takes one point per
    enrichment finding, capped; the counts cover both kinds.
    """
    quality = F.col("kind") == FD.QUALITY
    points = F.lit(0)
    for severity, weight in PENALTY.items():
        points = F.when(F.col("severity") == severity, weight).otherwise(points)
    counts = {s: F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in FD.SEVERITIES}
    totals = findings.agg(
        F.coalesce(F.sum(F.when(quality, points)), F.lit(0)).alias("penalty"),
        F.count_if(quality).alias("quality_findings"),
        F.count_if(~quality).alias("enrichment_findings"),
        F.count_if(quality & (F.col("severity") == "critical")).alias("quality_critical"),
        F.count_if(quality & (F.col("severity") == "high")).alias("quality_high"),
        *counts.values(),
    )
    score = F.greatest(
        F.lit(0), F.lit(100) - F.col("penalty") - F.least(F.col("enrichment_findings"), F.lit(ENRICHMENT_CAP))
    )
    sentence = F.format_string(
        "Quality findings: %d (critical %d, high %d). Enrichment findings: %d.",
        "quality_findings", "quality_critical", "quality_high", "enrichment_findings",
    )
    return totals.withColumn("health_score", score.cast("int")).select(
        "health_score",
        health_band(F.col("health_score")).alias("band"),
        *[f"{s}_count" for s in FD.SEVERITIES],
        sentence.alias("summary"),
    )


def findings_table(findings: DataFrame) -> DataFrame:
    """Findings by severity, numbered inside each severity (and kind)."""
    # one row per finding: bounded by the rules and the schema
    order = Window.partitionBy("kind", "severity").orderBy(*_reading_order())
    return (
        findings.withColumn("number", F.row_number().over(order))
        .withColumn("table", F.array_join("tables", ", "))
        .orderBy(F.desc("kind"), severity_rank(F.col("severity")), "number")
        .select("kind", "severity", "number", "code", "table", "column", "fix_risk", "description", "evidence")
    )


def _reading_order() -> list[Column]:
    return [F.array_join("tables", ","), F.col("column"), F.col("code"), F.col("description")]


def runbook(findings: DataFrame) -> DataFrame:
    """(phase, step, ...): green fixes, then fixes to review, then quality advisories."""
    quality, fixable = F.col("kind") == FD.QUALITY, F.col("fix").isNotNull()
    phase = (
        F.when((F.col("fix_risk") == "green") & fixable, 1)
        .when((F.col("fix_risk") == "yellow") & fixable, 2)
        .when((F.col("fix_risk") == "red") & quality, 3)
    )
    steps = findings.withColumn("phase", phase).where("phase IS NOT NULL")
    order = Window.partitionBy("phase").orderBy(F.desc("kind"), *_reading_order())
    return (
        steps.withColumn("step", F.row_number().over(order))
        .withColumn("table", F.array_join("tables", ", "))
        .orderBy("phase", "step")
        .select("phase", "step", "kind", "code", "table", "column", "fix", "investigation")
    )


def selected_fixes(findings: DataFrame, risk: str = "green") -> DataFrame:
    """Findings of a risk that still carry a fix."""
    return findings.where((F.col("fix_risk") == risk) & F.col("fix").isNotNull())


def scope(findings: DataFrame, source_type: str) -> DataFrame:
    """One row: source type and the sorted tables named in any finding."""
    tables = findings.select(F.explode("tables").alias("table")).distinct()
    # at most one entry per table of the source
    return tables.agg(
        F.lit(source_type.upper()).alias("source_type"),
        F.array_join(F.array_sort(F.collect_set("table")), ", ").alias("tables"),
    )


def scope_tables(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("tables").alias("table")).distinct().orderBy("table")


def combined(quality: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Both kinds of findings in one table."""
    return quality.unionByName(enrichment, allowMissingColumns=True)


def generated_at(moment: Column) -> Column:
    """Report time as text."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm 'UTC'")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document per row, for hand-over."""
    return rows.select(F.to_json(F.struct("*")).alias("document"))


def report_history(
    reports: DataFrame, jobs: DataFrame, sources: DataFrame, user_id, limit: int = 20
) -> DataFrame:
    """The latest reports of one user with their source, as many as asked for.

    ``reports`` (id, job_id, health_score, created_at), ``jobs`` (id, user_id,
    source_id), ``sources`` (id, name, source_type). The sort keeps only the
    wanted rows per task.
    """
    jobs = jobs.where(F.col("user_id") == F.lit(user_id)).select(F.col("id").alias("job_id"), "source_id")
    sources = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("source_type")
    )
    return (
        reports.join(jobs, "job_id")
        .join(sources, "source_id", "left")
        .select("id", "job_id", "health_score", "source_name", "source_type", "created_at")
        .orderBy(F.desc("created_at"), "id")
        .limit(limit)
    )


def latest(rows: DataFrame, order_by: str = "created_at", limit: int = 20) -> DataFrame:
    """The most recent rows, as many as asked for."""
    return rows.orderBy(F.desc(order_by), "id").limit(limit)
