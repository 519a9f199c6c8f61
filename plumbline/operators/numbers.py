"""Number-carrying values of a source in long form, and exact percentiles of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators.profile import ColumnSite, positional
from plumbline.operators.unions import union_all
from plumbline.sources.settle import settle


def number_rows(
    tables: Mapping[str, DataFrame], sites: Mapping[str, list[ColumnSite]], rule: str = "lenient"
) -> DataFrame:
    """(cid, x): every finite number in numeric and text columns."""
    parts = []
    for table, df in tables.items():
        members = [
            s
            for s in sites[table]
            if X.carries_number(s.dtype, rule) and not isinstance(s.dtype, T.BooleanType)
        ]
        if not members:
            continue
        data = positional(df)
        shaped = data.selectExpr(*[f"{X.number(f'c{s.ordinal}', s.dtype, rule)} AS `{s.cid}`" for s in members])
        parts.append(
            shaped.unpivot([], [f"`{s.cid}`" for s in members], "site", "x")
            .where("x IS NOT NULL")
            .selectExpr("coalesce(CAST(site AS INT), -1) AS cid", "x")
        )
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "cid int, x double")
    return union_all(parts)


def moments(rows: DataFrame) -> DataFrame:
    """(cid, n, mean, sd, lo, hi) of the numbers of each column."""
    return rows.groupBy("cid").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
    )


#: Fixed by the format of doubles: bits of the fraction, offset and least exponent of full precision.
FRACTION_BITS, EXPONENT_BIAS, LEAST_EXPONENT = 52, 1023, -1022


def order_bits(x: str) -> Column:
    """The bits of a finite double as a signed integer in the order of the doubles; both zeros are 0.

    The exponent is the logarithm's floor, put right where that was rounded over a power of
    two. Powers of two and quotients by them are exact, so the bits are.
    """
    size = F.abs(F.col(x))
    guess = F.greatest(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT))
    power = F.pow(F.lit(2.0), guess)
    # quotients, since twice the greatest power of two is no double
    exponent = guess + F.when(size / power >= 2, 1).when((size < power) & (guess > LEAST_EXPONENT), -1).otherwise(0)
    scaled = size / F.pow(F.lit(2.0), exponent)  # below 1 only for the smallest doubles, of which no leading bit is implied
    implied = (scaled >= 1).cast("long")
    fraction = ((scaled - implied) * F.lit(float(1 << FRACTION_BITS))).cast("long")
    bits = (exponent + EXPONENT_BIAS - 1 + implied) * (1 << FRACTION_BITS) + fraction
    return F.when(F.col(x) > 0, bits).when(F.col(x) < 0, -bits).otherwise(F.lit(0).cast("long"))


def percentile_discrete(rows: DataFrame, ranges: DataFrame, q: float, bits: int = 16) -> DataFrame:
    """(cid, percentile): smallest value with at least a share q of the rows at or below it.

    Exact for any size and skew without sorting a column in one task, by radix selection:
    each level counts the values of a column by their next ``bits`` bits, of those that share
    the bits settled so far. At most 2 ** ``bits`` counts per column leave a map task and meet in the task that
    finds where the wanted rank falls, however the values are distributed. It ends when one value
    is left per column, after 64 / ``bits`` levels at most.

    ``ranges`` has (cid, n, lo, hi), one row per column.
    """
    state = ranges.select(
        "cid",
        "lo",
        "hi",
        F.ceil(F.col("n") * F.lit(q)).alias("rank"),
        F.lit(0).cast("bigint").alias("below"),
    )
    shift = 64
    while shift > 0:
        shift = max(shift - bits, 0)
        state = settle(_selected(radix_counts(rows, state, shift), state))
        if state.where("lo <> hi").isEmpty():
            break
    return state.select("cid", F.col("lo").alias("percentile"))


def radix_counts(rows: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """(cid, slice, rows, lo, hi): values between a column's bounds, by their bits above ``shift``.

    The bounds are the extremes of one slice of the level before, so all but the last bits agree."""
    return (
        rows.join(F.broadcast(state.select("cid", F.col("lo").alias("from"), F.col("hi").alias("to"))), "cid")
        .where(F.col("x").between(F.col("from"), F.col("to")))
        .groupBy("cid", F.shiftright(order_bits("x"), shift).alias("slice"))
        .agg(F.count("x").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )


def _selected(counted: DataFrame, state: DataFrame) -> DataFrame:
    """Per column, the slice that holds the wanted rank."""
    running = Window.partitionBy("cid").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("below") + F.sum("rows").over(running)
    return (
        counted.join(F.broadcast(state.select("cid", "rank", "below")), "cid")
        .withColumn("reached", reached)
        .where((F.col("reached") >= F.col("rank")) & (F.col("reached") - F.col("rows") < F.col("rank")))
        .select("cid", "lo", "hi", "rank", (F.col("reached") - F.col("rows")).alias("below"))
    )
