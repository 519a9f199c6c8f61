"""Rows that refer to nothing: foreign key values without a parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import column_ref


def _common(child: DataFrame, child_key: Sequence[str], parent: DataFrame, parent_key: Sequence[str]) -> list[bool]:
    """For each part of the key whether it is compared as text: where just one side is text,
    so that a value which is no number refers to nothing instead of failing a cast."""
    text = [[isinstance(d.schema[c].dataType, T.StringType) for c in key] for d, key in ((child, child_key), (parent, parent_key))]
    return [a != b for a, b in zip(*text)]


def _part(column, as_text: bool):
    """Whole numbers in text lose leading zeros and a plus sign, as a cast would drop them."""
    if not as_text:
        return column
    text = F.trim(column.cast("string"))
    return F.coalesce(text.try_cast("decimal(38,0)").cast("string"), text)


def _keys(df: DataFrame, columns: Sequence[str], as_text: Sequence[bool]) -> DataFrame:
    """Complete key values as k0, k1, ...; a NULL part refers to nothing."""
    keys = df.select(*[_part(column_ref(c), t).alias(f"k{i}") for i, (c, t) in enumerate(zip(columns, as_text))])
    return keys.dropna()


def orphan_counts(
    child: DataFrame, child_key: Sequence[str], parent: DataFrame, parent_key: Sequence[str]
) -> DataFrame:
    """One row: referring rows, orphaned rows, orphaned distinct values.

    The child is counted per key value before the join, so a key held by a
    third of all rows reaches the join as a single row.
    """
    names = [f"k{i}" for i in range(len(child_key))]
    as_text = _common(child, child_key, parent, parent_key)
    counted = _keys(child, child_key, as_text).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    known = _keys(parent, parent_key, as_text).distinct().withColumn("known", F.lit(True))
    orphan = F.col("known").isNull()
    return counted.join(known, names, "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("referring_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_values"),
    )


def orphan_rows(
    child: DataFrame, child_key: Sequence[str], parent: DataFrame, parent_key: Sequence[str]
) -> DataFrame:
    """The orphaned child rows themselves. The parent is not made distinct: an anti join needs
    no such thing, and without it Spark can split a hot key of the child."""
    names = [f"k{i}" for i in range(len(child_key))]
    as_text = _common(child, child_key, parent, parent_key)
    known = _keys(parent, parent_key, as_text)
    keyed = child.withColumns({n: _part(column_ref(c), t) for n, c, t in zip(names, child_key, as_text)}).dropna(subset=names)
    return keyed.join(known, names, "left_anti").select(*[column_ref(c) for c in child.columns])
