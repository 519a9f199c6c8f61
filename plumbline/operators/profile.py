"""Column profiles: counts, text extremes, moments, distinct counts, top values.

A whole source is one plan with a fixed number of shuffles, whatever the number
of tables and columns, and two reads per column:

* ``column_stats``      aggregates without a shuffle of rows;
* ``value_frequencies`` every column of every table turned into (column, value)
  rows and counted by one shuffle, with map-side combining, from which the
  distinct counts, the text extremes and the top values are taken.

A frequent value is combined before the shuffle, so it arrives as one row per
map task.  A long text travels as its SHA-256 digest and a short prefix.  What is
left of the frequencies is a few rows per column and kept as a small table;
:mod:`long_ties` brings the long texts among them into the order of whole values.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.functions.types import canonical_type, sql_text
from plumbline.operators import flags, long_ties
from plumbline.operators.unions import union_all
from plumbline.sources.settle import settle


@dataclass(frozen=True)
class ProfileOptions:
    """How to profile.

    ``number_rule``   which text counts as a number: ``lenient`` or ``plain``.
    ``deviation``     ``sample`` or ``population``.
    ``pct_base``      share of a top value among ``non_null`` or ``all`` rows.
    ``inline_chars``  longer texts are grouped by digest.
    ``stats_width``   columns per aggregate; wider tables use several, each
                      reading only its own columns.
    """

    top_k: int = 20
    number_rule: str = "lenient"
    deviation: str = "sample"
    pct_base: str = "non_null"
    inline_chars: int = 128
    stats_width: int = 64

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 1000:
            # beyond that Spark no longer limits the values per partition
            raise ValueError(f"top_k must be between 1 and 1000, not {self.top_k}")
        if self.deviation not in ("sample", "population"):
            raise ValueError(f"deviation must be sample or population, not {self.deviation!r}")
        if self.pct_base not in ("non_null", "all"):
            raise ValueError(f"pct_base must be non_null or all, not {self.pct_base!r}")


TOP_VALUE = "struct<value:string,count:bigint,pct:double>"

PROFILE_COLUMNS = (
    "table",
    "column",
    "ordinal",
    "declared_type",
    "inferred_type",
    "row_count",
    "null_count",
    "null_pct",
    "distinct_count",
    "cardinality_ratio",
    "min_val",
    "max_val",
    "mean_val",
    "std_val",
    "top_values",
    "pattern_flags",
)


@dataclass(frozen=True)
class ColumnSite:
    """Where a profiled column lives: ``cid`` numbers all columns of the source."""

    cid: int
    table: str
    ordinal: int
    name: str
    dtype: T.DataType
    declared: str

    @property
    def slot(self) -> tuple[str, str]:
        return _slot(self.dtype)

    @property
    def is_text(self) -> bool:
        return self.slot[0] == "v_string"


def column_sites(
    tables: Mapping[str, DataFrame], expected: Mapping[str, Mapping[str, str]] | None = None
) -> dict[str, list[ColumnSite]]:
    """Column sites per table. ``expected`` overrides declared types by table and column."""
    sites, cid = {}, 0
    for table, df in tables.items():
        labels = (expected or {}).get(table, {})
        sites[table] = []
        for i, f in enumerate(df.schema.fields):
            declared = labels.get(f.name, canonical_type(f.dataType))
            sites[table].append(ColumnSite(cid, table, i, f.name, f.dataType, declared))
            cid += 1
    return sites


def positional(df: DataFrame) -> DataFrame:
    """Columns renamed to their position, so any name (dots, case) is safe."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


# --- first read: moments and text extremes ----------------------------------


def column_stats(
    tables: Mapping[str, DataFrame],
    sites: Mapping[str, list[ColumnSite]],
    options: ProfileOptions = ProfileOptions(),
) -> DataFrame:
    """One row per column: row count, mean, deviation; text min/max of text columns.

    Text and typed columns are aggregated apart, so that numeric moments stay in
    a generated hash aggregate (text min/max cannot) and each column is still
    read once. The text extremes of typed columns come from their distinct
    values, see :func:`value_summary`.
    """
    blocks, width = [], options.stats_width
    for table, df in tables.items():
        data = positional(df)
        for text in (False, True):
            group = [s for s in sites[table] if s.is_text is text]
            blocks += [_stats_block(data, group[i : i + width], options) for i in range(0, len(group), width)]
    return union_all(blocks)


def _stats_block(data: DataFrame, block: list[ColumnSite], options: ProfileOptions) -> DataFrame:
    spread = "stddev_samp" if options.deviation == "sample" else "stddev_pop"
    aggregates, entries = ["count(1) AS rows"], []
    for s in block:
        i, low, high, mean, deviation = s.ordinal, "NULL", "NULL", "NULL", "NULL"
        if X.carries_number(s.dtype, options.number_rule):
            value = X.number(f"c{i}", s.dtype, options.number_rule)
            aggregates += [f"avg({value}) AS avg{i}", f"{spread}({value}) AS sd{i}"]
            mean, deviation = f"avg{i}", f"sd{i}"
        if s.is_text:
            shown = X.rendered(f"c{i}", s.dtype)
            aggregates += [f"min({shown}) AS lo{i}", f"max({shown}) AS hi{i}"]
            low, high = f"lo{i}", f"hi{i}"
        entries.append(
            f"named_struct('cid', {s.cid}, 'row_count', rows, 'low', CAST({low} AS STRING), "
            f"'high', CAST({high} AS STRING), 'mean_val', CAST({mean} AS DOUBLE), "
            f"'std_val', CAST({deviation} AS DOUBLE))"
        )
    return data.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


# --- second read: value frequencies ----------------------------------------


def _slot(dtype: T.DataType) -> tuple[str, str]:
    """(slot column, slot type) in which values of a type are grouped."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "v_bigint", "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"v_{dtype.simpleString()}", dtype.simpleString()
    if isinstance(dtype, T.DecimalType):
        return f"v_decimal_{dtype.precision}_{dtype.scale}", dtype.simpleString()
    return "v_string", "string"


@dataclass(frozen=True)
class Frequencies:
    """Value counts of a source: ``counts`` has one row per (cid, value)."""

    counts: DataFrame
    slots: tuple[str, ...]


# Never NULL, and visibly so: a join on a nullable cid would push a NULL filter into
# one of the branches that share the frequencies, which would then be counted twice.
_CID = "coalesce(CAST(site AS INT), -1) AS cid"


def value_frequencies(
    tables: Mapping[str, DataFrame],
    sites: Mapping[str, list[ColumnSite]],
    options: ProfileOptions = ProfileOptions(),
) -> Frequencies:
    """Count every non-null value of every column, typed, in one shuffle."""
    kinds = {}  # slot -> type, over all tables
    for s in (s for group in sites.values() for s in group):
        kinds[s.slot[0]] = s.slot[1]
    slots = {**kinds, **({"digest": "string"} if "v_string" in kinds else {})}

    parts = []
    for table, df in tables.items():
        data = positional(df)
        for slot, kind in kinds.items():
            members = [s for s in sites[table] if s.slot[0] == slot]
            if not members:
                continue
            rows = _unpivot(data, members, kind)
            filled = {slot: "value"}
            if slot == "v_string":
                long = f"length(value) > {options.inline_chars}"
                filled = {
                    slot: f"left(value, {options.inline_chars})",
                    "digest": f"CASE WHEN {long} THEN sha2(value, 256) END",
                }
            keys = [f"{filled.get(s, f'CAST(NULL AS {t})')} AS {s}" for s, t in slots.items()]
            parts.append(rows.selectExpr(_CID, *keys))
    counts = union_all(parts).groupBy("cid", *slots).agg(F.count(F.lit(1)).alias("count"))
    return Frequencies(counts, tuple(slots))


def long_texts(
    tables: Mapping[str, DataFrame], sites: Mapping[str, list[ColumnSite]], cids: Iterable[int], inline_chars: int
) -> DataFrame:
    """(cid, value): the values of the given text columns that are longer than ``inline_chars``."""
    chosen, parts = set(cids), []
    for table, df in tables.items():
        members = [s for s in sites[table] if s.cid in chosen]
        if members:
            rows = _unpivot(positional(df), members, "string")
            parts.append(rows.where(f"length(value) > {inline_chars}").selectExpr(_CID, "value"))
    return union_all(parts)


def _unpivot(data: DataFrame, members: list[ColumnSite], kind: str) -> DataFrame:
    """(site, value) rows of the given columns, NULLs dropped; ``site`` is the cid as text."""
    shaped = data.selectExpr(
        *[
            (X.rendered(f"c{s.ordinal}", s.dtype) if kind == "string" else f"CAST(c{s.ordinal} AS {kind})")
            + f" AS `{s.cid}`"
            for s in members
        ]
    )
    return shaped.unpivot([], [f"`{s.cid}`" for s in members], "site", "value").where("value IS NOT NULL")


def value_summary(freq: Frequencies) -> DataFrame:
    """Per column: exact distinct values, value rows, text extremes of short values.

    Counting values and rows from the same frequencies keeps this branch and the
    top values on one shuffle, which Spark then runs once.
    """
    shown = _short_text(freq)
    return freq.counts.groupBy("cid").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.sum("count").alias("value_count"),
        F.min(shown).alias("short_low"),
        F.max(shown).alias("short_high"),
    )


def _short_text(freq: Frequencies) -> Column:
    return F.coalesce(*[F.col(s).cast("string") for s in freq.slots if s != "digest"])


def leading_values(freq: Frequencies, n: int) -> DataFrame:
    """The n most frequent values per column; equal counts in the order of values, long texts
    in that of their prefix.

    The window filters on ``row_number``, so Spark keeps only n rows per column
    and map partition before the shuffle.
    """
    order = Window.partitionBy("cid").orderBy(
        F.desc("count"), *[F.asc_nulls_first(s) for s in freq.slots]
    )
    top = freq.counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    digest = F.col("digest") if "digest" in freq.slots else F.lit(None).cast("string")
    return top.select("cid", "rank", _short_text(freq).alias("value"), digest.alias("digest"), "count")


def frequency_head(freq: Frequencies, k: int) -> DataFrame:
    """Of each column, the k + 1 leading values and, in a row of rank 0, its summary: what
    a profile needs of the frequencies, in one job."""
    summary = value_summary(freq).withColumn("rank", F.lit(0))
    return leading_values(freq, k + 1).unionByName(summary, allowMissingColumns=True)


# --- the profile --------------------------------------------------------------


def profile_tables(
    tables: Mapping[str, DataFrame],
    options: ProfileOptions = ProfileOptions(),
    expected_types: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Profile of a whole source: one row per column.

    Values are counted here and now, moments when the result is read.
    ``expected_types`` gives, per table and column, the declared type to report
    instead of the table's own.
    """
    tables = {name: df for name, df in tables.items() if df.columns}
    if not tables:
        raise ValueError("no columns to profile")
    return profile_sites(tables, column_sites(tables, expected_types), options)


def profile_sites(
    tables: Mapping[str, DataFrame], sites: Mapping[str, list[ColumnSite]], options: ProfileOptions = ProfileOptions()
) -> DataFrame:
    """Profile of the given columns; their ids count from 0."""
    # at most k + 2 rows per column
    head = settle(frequency_head(value_frequencies(tables, sites, options), options.top_k))
    ranked = long_ties.in_value_order(
        head, options.top_k, options.inline_chars, lambda cids: long_texts(tables, sites, cids, options.inline_chars)
    )
    top = flags.summarise_values(ranked)
    summary = head.where("rank = 0").select("cid", "distinct_count", "value_count", "short_low", "short_high")
    # all sides below have one row per column of the source
    stats = (
        column_stats(tables, sites, options)
        .join(F.broadcast(summary), "cid", "left")
        .fillna(0, ["distinct_count", "value_count"])
    )
    base = F.col("value_count") if options.pct_base == "non_null" else F.col("row_count")
    return (
        stats.join(top, "cid", "left")
        .withColumn("site", _site([s for group in sites.values() for s in group]))
        .select(
            "site.*",
            "row_count",
            (F.col("row_count") - F.col("value_count")).alias("null_count"),
            "distinct_count",
            F.coalesce("low", "short_low").alias("min_val"),
            F.coalesce("high", "short_high").alias("max_val"),
            "mean_val",
            "std_val",
            _shares(base).alias("top_values"),
            *flags.VALUE_SUMMARY,
            _ratio(F.col("row_count") - F.col("value_count"), F.col("row_count")).alias("null_pct"),
            _ratio(F.col("distinct_count"), F.col("value_count")).alias("cardinality_ratio"),
        )
        .withColumn("inferred_type", flags.inferred_type())
        .withColumn("pattern_flags", flags.pattern_flags())
        .select(*PROFILE_COLUMNS)
    )


def profile_table(name: str, df: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Profile of one table."""
    return profile_tables({name: df}, options)


def _site(sites: list[ColumnSite]) -> Column:
    """Names and declared type of the column a row is about."""
    entries = [
        f"named_struct('table', {sql_text(s.table)}, 'column', {sql_text(s.name)}, "
        f"'ordinal', {s.ordinal}, 'declared_type', {sql_text(s.declared)})"
        for s in sites
    ]
    return F.element_at(F.expr(f"array({', '.join(entries)})"), F.col("cid") + 1)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _shares(base: Column) -> Column:
    shares = F.transform(
        F.col("ranked"),
        lambda v: F.struct(
            v["value"].alias("value"),
            v["count"].alias("count"),
            (v["count"] * F.lit(100.0) / base).alias("pct"),
        ),
    )
    return F.coalesce(shares, F.array().cast(f"array<{TOP_VALUE}>"))


def top_values(profile: DataFrame) -> DataFrame:
    """Profile rows to long form: one row per (table, column, rank)."""
    return profile.select(
        "table", "column", F.posexplode("top_values").alias("pos", "v")
    ).select(
        "table",
        "column",
        (F.col("pos") + 1).alias("rank"),
        F.col("v.value").alias("value"),
        F.col("v.count").alias("count"),
        F.col("v.pct").alias("pct"),
    )


def rounded(profile: DataFrame, digits: int = 4) -> DataFrame:
    """Presentation form: ratios rounded."""
    return profile.withColumns(
        {c: F.round(c, digits) for c in ("null_pct", "cardinality_ratio")}
    )


def table_shapes(profile: DataFrame) -> DataFrame:
    """Rows and columns of each profiled table."""
    return profile.groupBy("table").agg(
        F.max("row_count").alias("rows"), F.count(F.lit(1)).alias("columns")
    )


def null_band(null_pct: Column) -> Column:
    """Colour of a null share."""
    return F.when(null_pct >= 0.5, "red").when(null_pct >= 0.2, "amber").otherwise("green")
