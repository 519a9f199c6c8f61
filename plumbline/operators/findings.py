"""The shape of a finding, shared by quality and enrichment rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIX = "struct<action:string,column:string,predicate:string,value:string>"
DRY_RUN = "struct<passed:boolean,estimated_rows_affected:bigint,error:string,disposition:string>"
SCHEMA = (
    "kind string, code string, tables array<string>, `column` string, severity string, fix_risk string, "
    f"description string, evidence map<string,double>, fix {FIX}, investigation string, dry_run {DRY_RUN}"
)
COLUMNS = (
    "kind code tables column severity fix_risk description evidence fix investigation dry_run".split()
)
SEVERITIES = ("critical", "high", "medium", "low")

QUALITY, ENRICHMENT = "quality", "enrichment"


def _text(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def set_value(column: Column | str, predicate: Column | str, value: Column | str) -> Column:
    """Fix: write an expression into the rows a predicate matches."""
    return F.struct(
        F.lit("set").alias("action"),
        _text(column).alias("column"),
        _text(predicate).alias("predicate"),
        _text(value).alias("value"),
    ).cast(FIX)


def drop_rows(column: Column | str, predicate: Column | str) -> Column:
    """Fix: remove the rows a predicate matches."""
    return F.struct(
        F.lit("drop_rows").alias("action"),
        _text(column).alias("column"),
        _text(predicate).alias("predicate"),
        F.lit(None).cast("string").alias("value"),
    ).cast(FIX)


def sql_name(column: Column) -> Column:
    """Column name quoted for use inside a fix or investigation predicate."""
    return F.concat(F.lit("`"), F.replace(column, F.lit("`"), F.lit("``")), F.lit("`"))


def finding(
    code: str,
    severity: Column | str,
    risk: Column | str,
    description: Column | str,
    evidence: Mapping[str, Column | str],
    *,
    table: Column | str = "table",
    column: Column | str | None = "column",
    fix: Column | None = None,
    investigation: Column | str | None = None,
    kind: str = QUALITY,
) -> Column:
    """One finding as a struct. ``table`` and ``column`` name columns of the input.

    A red finding never carries a fix, whatever the rule proposed.
    """
    pairs = []
    for name, value in evidence.items():
        pairs += [F.lit(name), (F.col(value) if isinstance(value, str) else value).cast("double")]
    table = F.col(table) if isinstance(table, str) else table
    column = F.col(column) if isinstance(column, str) else _text(column)
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(code).alias("code"),
        F.array(table).alias("tables"),
        column.alias("column"),
        _text(severity).alias("severity"),
        _text(risk).alias("fix_risk"),
        _text(description).alias("description"),
        F.create_map(*pairs).alias("evidence"),
        red_gate(_text(risk), fix if fix is not None else F.lit(None).cast(FIX)).alias("fix"),
        _text(investigation).alias("investigation"),
        F.lit(None).cast(DRY_RUN).alias("dry_run"),
    )


def red_gate(risk: Column, fix: Column) -> Column:
    """Advisory findings keep no runnable fix."""
    return F.when(risk != "red", fix)


def emit(rows: DataFrame, *structs: Column) -> DataFrame:
    """Non-null finding structs of each row, as finding rows."""
    return rows.select(F.inline(F.array_compact(F.array(*structs))))


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
