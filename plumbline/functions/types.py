"""Canonical type labels.

Every source column is described by one of six labels.  Spark columns are
mapped from their ``DataType``; textual catalog types (``DECIMAL(10,2)``) are
mapped by a column expression, so a catalog read over JDBC needs no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Catalog type name -> canonical label. Anything else is a string.
CATALOG_LABELS = {
    "SMALLINT": "integer",
    "INTEGER": "integer",
    "BIGINT": "integer",
    "HUGEINT": "integer",
    "FLOAT": "float",
    "DOUBLE": "float",
    "DECIMAL": "float",
    "NUMERIC": "float",
    "DATE": "date",
    "TIMESTAMP": "datetime",
    "TIMESTAMP WITH TIME ZONE": "datetime",
    "BOOLEAN": "boolean",
}

INTEGER, FLOAT, STRING = "integer", "float", "string"

_INTEGERS = (T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_INSTANTS = (T.TimestampType, T.TimestampNTZType)


def canonical_type(dtype: T.DataType) -> str:
    """Label of a Spark type. One-byte integers are strings, as for catalogs."""
    if isinstance(dtype, _INTEGERS):
        return INTEGER
    if isinstance(dtype, _FLOATS):
        return FLOAT
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, _INSTANTS):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return STRING


def catalog_label(type_name: Column) -> Column:
    """Label of a textual catalog type, parameters stripped."""
    bare = F.trim(F.split_part(F.upper(type_name), F.lit("("), F.lit(1)))
    pairs = [F.lit(x) for pair in CATALOG_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), bare), F.lit(STRING))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def quoted(name: str) -> str:
    """Backtick-quoted column name, safe for dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    """Text literal for use inside a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_ref(name: str) -> Column:
    return F.col(quoted(name))
