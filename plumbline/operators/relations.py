"""Relationships between tables: declared, or inferred from names, types and values.

Works on profiles, whose size is the number of columns in the source, so none
of these joins meets table data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.sources.catalog import DATABASE, DECLARED_KEY, Capabilities

# Confidence per kind of evidence, and the overlap that counts.
NAME_ONLY, NAME_AND_TYPE, WITH_OVERLAP, DECLARED = 0.5, 0.7, 0.9, 1.0
OVERLAP = 0.70
NUMBER_LABELS = ("integer", "float", "numeric", "bigint", "int")
TEXT_LABELS = ("string", "varchar", "text", "char")


def compatible_types(a: Column, b: Column) -> Column:
    return (
        (a == b)
        | (a.isin(*NUMBER_LABELS) & b.isin(*NUMBER_LABELS))
        | (a.isin(*TEXT_LABELS) & b.isin(*TEXT_LABELS))
    )


def target_keys(profile: DataFrame, singular_names: bool = False) -> DataFrame:
    """The column of each table that others refer to: ``id`` or ``{table}_id``.

    ``singular_names`` also accepts ``customer_id`` in ``customers``.
    """
    name, table = F.lower("column"), F.col("table")
    is_key = (name == "id") | (name == F.concat(table, F.lit("_id")))
    if singular_names:
        is_key = is_key | (name == F.concat(X.singular(F.lower(table)), F.lit("_id")))
    key = F.struct(
        F.col("column").alias("to_column"),
        F.col("inferred_type").alias("to_type"),
        _texts().alias("to_values"),
    )
    return (
        profile.where(is_key)
        .groupBy(F.col("table").alias("to_table"))
        .agg(F.min_by(key, "ordinal").alias("key"))
        .select("to_table", "key.*")
    )


def _texts() -> Column:
    return F.array_distinct(F.transform("top_values", lambda v: v["value"]))


def candidates(profile: DataFrame, singular_names: bool = False) -> DataFrame:
    """Columns whose name points at another table that has a key.

    A column can only name three tables (its stem, with ``s``, with ``es``), so
    the names are generated and joined by equality.
    """
    stem = X.key_stem(F.col("column"))
    names = F.array(stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es")))
    sources = profile.select(
        F.col("table").alias("from_table"),
        F.col("column").alias("from_column"),
        F.col("inferred_type").alias("from_type"),
        _texts().alias("from_values"),
        F.explode(names).alias("target_name"),
    )
    keys = target_keys(profile, singular_names).withColumn("target_name", F.lower("to_table"))
    return sources.join(keys, "target_name").where(F.col("from_table") != F.col("to_table")).drop("target_name")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared values over the smaller set; 0 when either set is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def infer_relations(
    profile: DataFrame,
    declared: DataFrame | None = None,
    capabilities: Capabilities = DATABASE,
    singular_names: bool = False,
) -> DataFrame:
    """Declared keys first, then inferred ones, each with confidence and evidence.

    Materialise the profile beforehand: it is read once per side of the join.
    """
    found = candidates(profile, singular_names)
    use_declared = declared is not None and capabilities.has_declared_fks
    if use_declared:
        declared = declared.select(*DECLARED_KEY).dropDuplicates()
        found = found.join(declared, list(DECLARED_KEY), "left_anti")

    typed = compatible_types(F.col("from_type"), F.col("to_type"))
    overlapping = F.col("overlap") >= OVERLAP
    inferred = found.withColumn("overlap", overlap_ratio(F.col("from_values"), F.col("to_values"))).select(
        *DECLARED_KEY,
        F.when(overlapping, WITH_OVERLAP).when(typed, NAME_AND_TYPE).otherwise(NAME_ONLY).alias("confidence"),
        F.array_compact(
            F.array(
                F.lit("name_match"),
                F.when(typed, "type_compatible"),
                F.when(overlapping, F.format_string("value_overlap:%.2f", "overlap")),
            )
        ).alias("evidence"),
        F.lit(False).alias("is_declared"),
    )
    if not use_declared:
        return inferred
    seeds = declared.select(
        *DECLARED_KEY,
        F.lit(DECLARED).alias("confidence"),
        F.array(F.lit("declared_fk")).alias("evidence"),
        F.lit(True).alias("is_declared"),
    )
    return seeds.unionByName(inferred)


def relationship_map(relations: DataFrame) -> DataFrame:
    """Declared relations, then inferred ones by falling confidence."""
    return relations.select(
        *DECLARED_KEY,
        F.format_string("%.2f", "confidence").alias("confidence"),
        F.array_join("evidence", ", ").alias("evidence"),
        "is_declared",
    ).orderBy(F.desc("is_declared"), F.desc("confidence"), *DECLARED_KEY)
