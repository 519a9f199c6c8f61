"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    decontamination,
    filter_audit,
    html_text,
    language,
    license_scan,
    ngram_join,
    packing,
    periodic_runs,
    quality_model,
    quality_rules,
    secrets,
    toxicity,
    url_filter,
)
from plumbline.llm.tables import fold, read


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("runs")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 4) == 2
    model = quality_model.fit(docs, labels.filter(~held_out).select("doc_id", F.col("quality").alias("label")))
    scored = quality_model.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 5) == 0
    confirmed = labels.filter(~held_out).select("doc_id", (F.col("toxic") == 1).alias("confirmed"))
    model = toxicity.fit(docs.filter(~held_out), confirmed)
    scored = toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rules(spark))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    return language.identify(docs, language.fit(docs.filter(~held_out)), {"doc_id": F.col("doc_id"), "held_out": held_out})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the labels is kept out of learning, to measure the rules by."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rules = quality_rules.fit(docs, labels.filter(fold("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label")))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(read(spark, sf_dir, "documents"))))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def register() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Query and SQL, None where SQL cannot express it; those are tested against brute force."""
    return {
        "op1_ngram_join": (op1_ngram_join, None),
        "op2_secret_scan": (op2_secret_scan, secrets.SQL),
        "op3_packing": (op3_packing, None),
        "op4_decontamination": (op4_decontamination, decontamination.SQL),
        "op5_quality_model": (op5_quality_model, None),
        "op6_html_text": (op6_html_text, None),
        "op7_toxicity": (op7_toxicity, None),
        "op8_url_filter": (op8_url_filter, url_filter.SQL),
        "op9_language": (op9_language, None),
        "op10_quality_rules": (op10_quality_rules, None),
        "op11_periodic_runs": (op11_periodic_runs, None),
        "op12_license_scan": (op12_license_scan, license_scan.SQL),
        "op13_filter_audit": (op13_filter_audit, filter_audit.SQL),
    }
