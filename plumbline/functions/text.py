r"""Text rendering, numeric coercion and the value shapes used by the rules.

All shapes use ``[0-9]`` and ``\z`` so that they mean the same in any regular
expression engine without look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import quoted, sql_text

# Shapes of text that carry a type.
ISO_DATE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"
)
WHOLE_NUMBER = r"^-?[0-9]{1,20}\z"
REAL_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
BOOLEAN_WORDS = ("0", "1", "true", "false", "yes", "no", "t", "f", "y", "n")

# Which text counts as a number when averaging a text column.
LENIENT_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]*)?\z"

# Further shapes used by the format rules.
NAMED_DATE = r"^[A-Z][a-z]{2} [0-9]{1,2},? [0-9]{4}\z"
SLASHED_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\z"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"

NUMBER_RULES = ("lenient", "plain")


def rendered(name: str, dtype: T.DataType) -> str:
    """SQL of a column's text form; nested values render as JSON."""
    if isinstance(dtype, T.StringType):
        return quoted(name)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return f"to_json({quoted(name)})"
    return f"CAST({quoted(name)} AS STRING)"


# What a text must satisfy, byte by byte, before a shape is worth matching: blanks,
# signs, points and digits all sort below a colon.
_FIRST_BYTES = {
    ISO_DATE: "{c} < ':'",
    SLASHED_DATE: "{c} < ':'",
    LENIENT_NUMBER: "{c} < ':'",
    PLAIN_NUMBER: "{c} < ':'",
    NAMED_DATE: "{c} >= 'A' AND {c} < '['",
    EMAIL: "contains({c}, '@')",
}


def matches(name: str, shape: str) -> str:
    """SQL of a shape test on a text column, cheap for texts that cannot match."""
    col = quoted(name)
    return f"({_FIRST_BYTES[shape].format(c=col)} AND {col} RLIKE {sql_text(shape)})"


def carries_number(dtype: T.DataType, rule: str = "lenient") -> bool:
    """Whether any value of the type can be averaged under the rule."""
    if rule not in NUMBER_RULES:
        raise ValueError(f"number rule must be one of {NUMBER_RULES}, not {rule!r}")
    if isinstance(dtype, T.BooleanType):
        return rule == "lenient"
    return isinstance(dtype, (T.StringType, T.NumericType))


def number(name: str, dtype: T.DataType, rule: str = "lenient") -> str:
    """SQL of the number a column's value carries, or NULL.

    ``lenient`` accepts anything a cast accepts (signs, exponents, leading
    point, booleans as 0/1); ``plain`` accepts digits with an optional minus
    and fraction, as decimal.  Dates and timestamps carry no number under
    either rule, and numbers that are not finite count as none.
    """
    col = quoted(name)
    if not carries_number(dtype, rule):
        return "CAST(NULL AS DOUBLE)"
    if isinstance(dtype, T.StringType):
        if rule == "plain":
            number = f"CAST(try_cast({col} AS DECIMAL(38,10)) AS DOUBLE)"
            return f"CASE WHEN {matches(name, PLAIN_NUMBER)} THEN {number} END"
        gate, number = f"{matches(name, LENIENT_NUMBER)} AND ", f"try_cast({col} AS DOUBLE)"
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        gate, number = "", f"CAST({col} AS DOUBLE)"
    elif isinstance(dtype, T.BooleanType):
        return f"CAST(CAST({col} AS INT) AS DOUBLE)"
    else:
        return f"CAST({col} AS DOUBLE)"
    # NaN sorts above infinity in Spark, so one comparison drops both.
    return f"CASE WHEN {gate}abs({number}) < double('infinity') THEN {number} END"


def key_stem(name: Column) -> Column:
    """``customer_id`` -> ``customer``: lower case without the key suffix."""
    return F.regexp_replace(F.lower(name), r"(_id|_key|_fk)\z", "")


def singular(table: Column) -> Column:
    """Table name without one plural ending; names in -ss stay as they are."""
    return (
        F.when(table.rlike(r"(ss|x|ch|sh)es\z"), F.regexp_replace(table, r"es\z", ""))
        .when(table.rlike(r"[^s]s\z"), F.regexp_replace(table, r"s\z", ""))
        .otherwise(table)
    )
