"""Redaction of profiles and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pii
from plumbline.functions.types import column_ref


def redact_profile(
    profile: DataFrame, entities: Sequence[str] = pii.ENTITIES, extremes: bool = True
) -> DataFrame:
    """Profile with redacted top values and, by default, text extremes.

    Counts and shares stay. ``extremes=False`` leaves min and max as they are.
    """
    values = F.transform(
        "top_values",
        lambda v: F.struct(
            pii.redact(v["value"], entities).alias("value"), v["count"].alias("count"), v["pct"].alias("pct")
        ),
    )
    changed = {"top_values": values}
    if extremes:
        changed |= {c: pii.redact(F.col(c), entities) for c in ("min_val", "max_val")}
    return profile.withColumns(changed)


def redact_columns(df: DataFrame, columns: Sequence[str], entities: Sequence[str] = pii.ENTITIES) -> DataFrame:
    """Table with the given text columns redacted, row by row, whole texts."""
    return df.select(
        *[(pii.redact(column_ref(c), entities) if c in columns else column_ref(c)).alias(c) for c in df.columns]
    )


def entity_report(df: DataFrame, columns: Sequence[str], entities: Sequence[str] = pii.ENTITIES) -> DataFrame:
    """(column, entity, hits, rows): what redaction would replace. One aggregate, no shuffle of rows."""
    counts = {
        (c, e): n.alias(f"h{i}_{j}")
        for i, c in enumerate(columns)
        for j, (e, n) in enumerate(pii.entity_counts(column_ref(c), entities).items())
    }
    counted = df.select(*counts.values())
    places = list(zip(counts, counted.columns))
    aggregates, entries = [], []
    for (column, entity), name in places:
        hits, rows = F.coalesce(F.sum(name), F.lit(0)), F.count_if(F.col(name) > 0)
        aggregates += [hits.alias(f"{name}_hits"), rows.alias(f"{name}_rows")]
        entries.append(
            F.struct(
                F.lit(column).alias("column"),
                F.lit(entity).alias("entity"),
                F.col(f"{name}_hits").alias("hits"),
                F.col(f"{name}_rows").alias("rows"),
            )
        )
    return counted.agg(*aggregates).select(F.inline(F.array(*entries)))
