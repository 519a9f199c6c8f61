"""Union of many parts as a balanced tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts with equal columns, stacked. Pairing neighbours keeps the plan shallow,
    so that analysing a source of many tables stays cheap; Spark flattens it."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]
