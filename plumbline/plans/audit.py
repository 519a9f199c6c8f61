"""The whole audit of a source: profile, relations, findings, fixes, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.operators import enrichment, fixes, quality
from plumbline.operators.isolation import profile_isolated, readable_columns
from plumbline.operators.profile import ProfileOptions
from plumbline.operators.redaction import redact_profile
from plumbline.operators.relations import infer_relations
from plumbline.plans import report
from plumbline.sources.catalog import FILES, Capabilities
from plumbline.sources.settle import settle


@dataclass(frozen=True)
class Audit:
    """Result tables of an audit; all but ``cleaned`` are bounded by the schema. Columns in
    ``unreadable`` (table, column, error) are in none of the others."""

    profile: DataFrame
    relations: DataFrame
    findings: DataFrame
    best_enrichment: DataFrame
    summary: DataFrame
    runbook: DataFrame
    cleaned: dict[str, DataFrame]
    unreadable: DataFrame


def audit(
    tables: Mapping[str, DataFrame],
    *,
    declared_keys: DataFrame | None = None,
    capabilities: Capabilities = FILES,
    formulas: Sequence[quality.Formula] = (),
    keys: Mapping[str, Sequence[str]] | None = None,
    expected_types: Mapping[str, Mapping[str, str]] | None = None,
    profile_options: ProfileOptions = ProfileOptions(),
    singular_names: bool = True,
    thresholds: quality.Thresholds = quality.DEFAULT,
    enrich: bool = True,
) -> Audit:
    """Audit a source. Tables are read by the rules that need them; what passes
    between the steps has one row per column or finding and is settled."""
    profile, unreadable = profile_isolated(tables, profile_options, expected_types)
    if profile is None:
        raise ValueError("no column can be read")
    profile, tables = settle(profile), readable_columns(tables, unreadable)
    relations = settle(infer_relations(profile, declared_keys, capabilities, singular_names))
    found = quality.quality_findings(tables, profile, relations, formulas, keys, thresholds)
    if enrich:
        found = report.combined(found, enrichment.enrichment_findings(tables, profile))
    found = settle(found)
    disposed, runs, outcomes = fixes.validate(tables, found)
    disposed = settle(disposed)
    cleaned = {}
    if capabilities.is_mutable_copy:
        cleaned = {t: fixes.apply_fixes(df, t, runs, outcomes) for t, df in tables.items()}
    return Audit(
        profile=redact_profile(profile),
        relations=relations,
        findings=disposed,
        best_enrichment=enrichment.best(disposed.where("kind = 'enrichment'")),
        summary=report.summary(disposed),
        runbook=report.runbook(disposed),
        cleaned=cleaned,
        unreadable=unreadable,
    )
