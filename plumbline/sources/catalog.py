"""Table listings, row counts, samples and declared keys from catalog tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import canonical_type

DECLARED_KEY = ("from_table", "from_column", "to_table", "to_column")


@dataclass(frozen=True)
class Capabilities:
    """What a source can tell about itself."""

    has_declared_types: bool = False
    has_declared_fks: bool = False
    is_mutable_copy: bool = True


FILES = Capabilities()
DATABASE = Capabilities(has_declared_types=True, has_declared_fks=True, is_mutable_copy=False)


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, ordinal, declared_type, nullable) of every table, in order.

    The rows come from the schemas alone; no data is read.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, f.name, i, canonical_type(f.dataType), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "`table` string, `column` string, ordinal int, declared_type string, nullable boolean"
    return spark.createDataFrame(rows, schema)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, row_count) of every table; one metadata-light aggregate each."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
            for name, df in tables.items()
        ],
    )


def sample_rows(df: DataFrame, n: int = 1000, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first n rows, in a given order if any."""
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(n)


# --- declared foreign keys --------------------------------------------------


def declared_keys_ansi(
    constraints: DataFrame,
    key_columns: DataFrame,
    target_columns: DataFrame | None = None,
    schema: str = "public",
    references: DataFrame | None = None,
) -> DataFrame:
    """Foreign keys from ``table_constraints``, ``key_column_usage`` and ``constraint_column_usage``.

    With ``references`` (``referential_constraints``) a key's columns meet those of the unique
    constraint it refers to by ``position_in_unique_constraint``, so that composite keys are
    matched as declared; ``target_columns`` is not needed then. Without it, composite keys are
    matched by position when both usages carry ``ordinal_position``; otherwise every source column
    meets every target column of its constraint.
    """
    if references is not None:
        return _by_reference(constraints, key_columns, references, schema)
    if target_columns is None:
        raise ValueError("needs constraint_column_usage or referential_constraints")
    on = ["constraint_name", "table_schema"]
    fks = constraints.where(
        (F.col("constraint_type") == "FOREIGN KEY") & (F.col("table_schema") == schema)
    ).select(*on, F.col("table_name").alias("from_table"))
    from_side = key_columns.select(
        *on,
        F.col("table_name").alias("from_table"),
        F.col("column_name").alias("from_column"),
        *_position(key_columns),
    )
    to_side = target_columns.select(
        *on,
        F.col("table_name").alias("to_table"),
        F.col("column_name").alias("to_column"),
        *_position(target_columns),
    )
    by_position = "ordinal_position" in from_side.columns and "ordinal_position" in to_side.columns
    pairs = fks.join(from_side, [*on, "from_table"]).join(
        to_side, [*on, "ordinal_position"] if by_position else on
    )
    return pairs.select(*DECLARED_KEY).dropDuplicates()


def _by_reference(constraints: DataFrame, key_columns: DataFrame, references: DataFrame, schema: str) -> DataFrame:
    """Names of constraints may be reused by tables; a key's columns are those of its own table."""
    fks = constraints.where((F.col("constraint_type") == "FOREIGN KEY") & (F.col("table_schema") == schema))
    fks = fks.select("constraint_name", "table_schema", F.col("table_name").alias("from_table"))
    from_side = key_columns.select(
        "constraint_name",
        "table_schema",
        F.col("table_name").alias("from_table"),
        F.col("column_name").alias("from_column"),
        F.col("position_in_unique_constraint").alias("position"),
    )
    refers = references.select(
        "constraint_name",
        F.col("constraint_schema").alias("table_schema"),
        F.col("unique_constraint_name").alias("target_name"),
        F.col("unique_constraint_schema").alias("target_schema"),
    )
    to_side = key_columns.select(
        F.col("constraint_name").alias("target_name"),
        F.col("table_schema").alias("target_schema"),
        F.col("table_name").alias("to_table"),
        F.col("column_name").alias("to_column"),
        F.col("ordinal_position").alias("position"),
    )
    pairs = fks.join(from_side, ["constraint_name", "table_schema", "from_table"])
    pairs = pairs.join(refers, ["constraint_name", "table_schema"]).join(to_side, ["target_name", "target_schema", "position"])
    return pairs.select(*DECLARED_KEY).dropDuplicates()


def _position(usage: DataFrame) -> list[str]:
    return ["ordinal_position"] if "ordinal_position" in usage.columns else []


def declared_keys_mysql(key_columns: DataFrame, constraints: DataFrame, schema: str) -> DataFrame:
    """Foreign keys from a ``key_column_usage`` that names its own target."""
    on = ["constraint_name", "table_schema", "table_name"]
    fks = constraints.where(F.col("constraint_type") == "FOREIGN KEY").select(*on)
    return (
        key_columns.where(
            (F.col("table_schema") == schema) & F.col("referenced_table_name").isNotNull()
        )
        .join(fks, on)
        .select(
            F.col("table_name").alias("from_table"),
            F.col("column_name").alias("from_column"),
            F.col("referenced_table_name").alias("to_table"),
            F.col("referenced_column_name").alias("to_column"),
        )
        .dropDuplicates()
    )


def declared_keys_mssql(key_columns: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign keys from object and column numbers (``foreign_key_columns``)."""

    def side(object_id: str, column_id: str, prefix: str) -> DataFrame:
        names = tables.select(F.col("object_id"), F.col("name").alias(f"{prefix}_table"))
        return columns.join(names, "object_id").select(
            F.col("object_id").alias(object_id),
            F.col("column_id").alias(column_id),
            f"{prefix}_table",
            F.col("name").alias(f"{prefix}_column"),
        )

    return (
        key_columns.join(side("parent_object_id", "parent_column_id", "from"), ["parent_object_id", "parent_column_id"])
        .join(
            side("referenced_object_id", "referenced_column_id", "to"),
            ["referenced_object_id", "referenced_column_id"],
        )
        .select(*DECLARED_KEY)
        .dropDuplicates()
    )
