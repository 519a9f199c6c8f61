"""Type inference and pattern flags, computed from a column's top values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

# Flag thresholds.
ENUM_RATIO = 0.05
BOOLEAN_DISTINCT = 3
HIGH_NULL = 0.20
CRITICAL_NULL = 0.50
NEAR_UNIQUE_RATIO = 0.98
NEAR_UNIQUE_DISTINCT = 10
INFERENCE_VALUES = 20

VALUE_SUMMARY = (
    "all_dates",
    "all_whole",
    "all_real",
    "all_words",
    "listed",
    "numeric_listed",
    "boolean_listed",
)


def summarise_values(ranked: DataFrame) -> DataFrame:
    """One row per column over its ranked values: shapes they all share, and the list."""
    v = F.col("value")
    first = F.col("rank") <= INFERENCE_VALUES
    whole, real = v.rlike(X.WHOLE_NUMBER), v.rlike(X.REAL_NUMBER)
    word = F.lower(v).isin(*X.BOOLEAN_WORDS)

    def every(test: Column) -> Column:
        return F.bool_and(F.when(first, test))

    return ranked.groupBy("cid").agg(
        every(v.rlike(X.ISO_DATE)).alias("all_dates"),
        every(whole).alias("all_whole"),
        every(real).alias("all_real"),
        every(word).alias("all_words"),
        F.count(F.lit(1)).alias("listed"),
        F.count_if(whole | real).alias("numeric_listed"),
        F.count_if(word).alias("boolean_listed"),
        # at most k entries per column
        F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("ranked"),
    )


def inferred_type() -> Column:
    """First type that all leading values share; only text columns are inferred."""
    declared = F.col("declared_type")
    return (
        F.when(~declared.isin("string", "VARCHAR"), declared)
        .when(F.col("all_dates"), "date")
        .when(F.col("all_whole"), "integer")
        .when(F.col("all_real"), "float")
        .when(F.col("all_words"), "boolean")
        .otherwise("string")
    )


def pattern_flags() -> Column:
    """Ordered list of the flags a profile row earns."""
    rows, nulls, null_pct = F.col("row_count"), F.col("null_count"), F.col("null_pct")
    distinct, ratio = F.col("distinct_count"), F.col("cardinality_ratio")
    declared, inferred = F.col("declared_type"), F.col("inferred_type")
    listed, numbers = F.coalesce("listed", F.lit(0)), F.coalesce("numeric_listed", F.lit(0))

    emptiness = (
        F.when((rows > 0) & (nulls == rows), "all_null")
        .when(null_pct >= CRITICAL_NULL, "high_null_critical")
        .when(null_pct >= HIGH_NULL, "high_null")
    )
    boolean = (distinct <= BOOLEAN_DISTINCT) & (listed > 0) & (F.col("boolean_listed") == listed)
    return F.array_compact(
        F.array(
            emptiness,
            F.when((ratio <= ENUM_RATIO) & (distinct > 1), "possible_enum"),
            F.when(boolean, "possible_boolean"),
            F.when((ratio >= NEAR_UNIQUE_RATIO) & (distinct > NEAR_UNIQUE_DISTINCT), "near_unique"),
            F.when((declared != inferred) & (declared != "string"), "type_mismatch"),
            F.when((declared == "string") & (numbers > 0) & (numbers < listed), "mixed_types"),
        )
    )
