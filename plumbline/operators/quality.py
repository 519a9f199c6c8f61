"""Quality rules: deterministic findings over profiles and, where needed, tables.

Rules that only need statistics read the profile (as many rows as the source
has columns).  Rules over values scan each table once for all its columns.  Every
threshold is a named parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.functions.types import column_ref, is_numeric, sql_text
from plumbline.operators import findings as FD
from plumbline.operators import numbers
from plumbline.operators.orphans import orphan_counts
from plumbline.operators.profile import column_sites, positional
from plumbline.operators.unions import union_all
from plumbline.sources.settle import settle


@dataclass(frozen=True)
class Thresholds:
    """Where rules fire."""

    null_critical: float = 0.50
    null_high: float = 0.20
    null_medium: float = 0.05
    key_ratio: float = 0.90  # a column this distinct may be a table's key
    own_key_ratio: float = 0.98  # a column named as the key should be this distinct
    label_ratio: float = 0.50  # text this repetitive holds labels
    email_share: float = 0.50  # text this often an address holds addresses
    outlier_deviations: float = 3.0
    outlier_ratio: float = 10.0
    outlier_quantile: float = 0.95
    negative_share: float = 0.05
    formula_tolerance: float = 0.005


DEFAULT = Thresholds()


@dataclass(frozen=True)
class Formula:
    """A declared rule of a table: ``target = left * right``."""

    table: str
    target: str
    left: str
    right: str


# --- rules over the profile ----------------------------------------------------


def null_findings(profile: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """ALL_NULL, NULL_CRITICAL or NULL_EXCESS: the one that fits the null share."""
    pct = F.col("null_pct")
    evidence = {"null_pct": "null_pct", "null_count": "null_count", "row_count": "row_count"}
    nulls = F.concat(FD.sql_name(F.col("column")), F.lit(" IS NULL"))
    share = F.format_string("%.1f%% of the rows have no value", pct * 100)
    level = (
        F.when(pct >= t.null_high, "high").when(pct >= t.null_medium, "medium").otherwise("low")
    )
    everything = FD.finding(
        "ALL_NULL", "critical", "red", "No row has a value", evidence, investigation=nulls
    )
    most = FD.finding("NULL_CRITICAL", "critical", "red", share, evidence, investigation=nulls)
    some = FD.finding(
        "NULL_EXCESS", level, "yellow", share, evidence,
        fix=FD.drop_rows(F.col("column"), nulls), investigation=nulls,
    )
    return FD.emit(
        profile.where("row_count > 0"),
        F.when(pct == 1.0, everything).when(pct >= t.null_critical, most).when(pct > 0, some),
    )


def type_findings(profile: DataFrame) -> DataFrame:
    """TYPE_MISMATCH and MIXED_TYPES, from the pattern flags."""
    evidence = {"distinct_count": "distinct_count", "row_count": "row_count"}
    name = FD.sql_name(F.col("column"))
    numeric_text = F.concat(name, F.lit(" RLIKE "), F.lit("'" + X.REAL_NUMBER.replace("\\", "\\\\") + "'"))
    mismatch = FD.finding(
        "TYPE_MISMATCH", "high", "red",
        F.format_string("Declared %s, values look like %s", "declared_type", "inferred_type"), evidence,
        investigation=F.concat(name, F.lit(" IS NOT NULL")),
    )
    mixed = FD.finding(
        "MIXED_TYPES", "high", "red", "Frequent values mix numbers and other text", evidence,
        investigation=numeric_text,
    )
    return FD.emit(
        profile,
        F.when(F.array_contains("pattern_flags", "type_mismatch"), mismatch),
        F.when(F.array_contains("pattern_flags", "mixed_types"), mixed),
    )


def own_key_findings(profile: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """CARDINALITY_ANOMALY: a column named as its table's key that repeats."""
    name, table = F.lower("column"), F.lower("table")
    own = (
        (name == "id")
        | (name == F.concat(table, F.lit("_id")))
        | (name == F.concat(X.singular(table), F.lit("_id")))
    )
    rows = profile.where(own & (F.col("row_count") > F.col("null_count")))
    return FD.emit(
        rows.where(F.col("cardinality_ratio") < t.own_key_ratio),
        FD.finding(
            "CARDINALITY_ANOMALY", "medium", "red",
            "Named as the key of its table but its values repeat",
            {"cardinality_ratio": "cardinality_ratio", "distinct_count": "distinct_count"},
        ),
    )


def table_keys(profile: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(table, key, ...) the first column named like a key that is distinct enough."""
    name = F.lower("column")
    named = (name == "id") | name.endswith("_id")
    facts = F.struct(F.col("column").alias("key"), "row_count", "null_count", "distinct_count")
    return (
        profile.where(named & (F.col("cardinality_ratio") >= t.key_ratio))
        .groupBy("table")
        .agg(F.min_by(facts, "ordinal").alias("facts"))
        .select("table", "facts.*")
    )


def duplicate_key_findings(profile: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """POSSIBLE_DUPLICATE: repeated values of a table's key, from exact counts."""
    rows = table_keys(profile, t).withColumn(
        "duplicate_rows", F.col("row_count") - F.col("null_count") - F.col("distinct_count")
    )
    return FD.emit(rows.where("duplicate_rows > 0"), _duplicate_key("key"))


def _duplicate_key(column: str) -> Column:
    return FD.finding(
        "POSSIBLE_DUPLICATE", "critical", "red", "Key values repeat",
        {"duplicate_rows": "duplicate_rows", "row_count": "row_count"}, column=column,
    )


# --- rules over values -----------------------------------------------------------


def value_scan(tables: Mapping[str, DataFrame], width: int = 32) -> DataFrame:
    """(table, column, counts of each shape): aggregates without a shuffle of rows."""
    blocks = []
    for table, df in tables.items():
        data, fields = positional(df), list(enumerate(df.schema.fields))
        # a wide table is cut into blocks of columns, each reading only its own
        for start in range(0, len(fields), width):
            aggregates, entries = [], []
            for i, f in fields[start : start + width]:
                tests = _shape_tests(f"c{i}", f.dataType)
                if not tests:
                    continue
                aggregates.append(f"count(c{i}) AS filled{i}")
                aggregates += [f"count_if({test}) AS {name}{i}" for name, test in tests.items()]
                counts = [f"'{name}', {f'{name}{i}' if name in tests else '0L'}" for name in SHAPES]
                entries.append(
                    f"named_struct('table', {sql_text(table)}, 'column', {sql_text(f.name)}, "
                    f"'filled', filled{i}, 'texts', {f'filled{i}' if isinstance(f.dataType, T.StringType) else '0L'}, {', '.join(counts)})"
                )
            if entries:
                blocks.append(data.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))"))
    if not blocks:
        spark = next(iter(tables.values())).sparkSession
        counts = ", ".join(f"{name} bigint" for name in ("filled", "texts", *SHAPES))
        return spark.createDataFrame([], f"`table` string, `column` string, {counts}")
    return union_all(blocks)


SHAPES = ("iso_dates", "named_dates", "slashed_dates", "addresses", "numbers", "negatives")


def _shape_tests(name: str, dtype: T.DataType) -> dict[str, str]:
    """SQL of the shapes a column's values are counted by."""
    if isinstance(dtype, T.StringType):
        number = X.matches(name, X.LENIENT_NUMBER)
        return {
            "iso_dates": X.matches(name, X.ISO_DATE),
            "named_dates": X.matches(name, X.NAMED_DATE),
            "slashed_dates": X.matches(name, X.SLASHED_DATE),
            "addresses": X.matches(name, X.EMAIL),
            "numbers": number,
            "negatives": f"(contains({name}, '-') AND {number} AND try_cast({name} AS DOUBLE) < 0)",
        }
    if is_numeric(dtype):
        return {"numbers": f"{name} IS NOT NULL", "negatives": f"{name} < 0"}
    return {}


def format_findings(scan: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """INCONSISTENT_FORMAT for dates of several shapes and for malformed addresses."""
    shapes = ("iso_dates", "named_dates", "slashed_dates")
    styles = sum(((F.col(s) > 0).cast("int") for s in shapes), F.lit(0))
    rows = scan.withColumns({"date_styles": styles, "malformed": F.col("filled") - F.col("addresses")})
    name = FD.sql_name(F.col("column"))
    named = F.concat(name, F.lit(" RLIKE '" + X.NAMED_DATE.replace("\\", "\\\\") + "'"))
    to_iso = F.concat(
        F.lit("date_format(try_to_timestamp(replace("),
        name,
        F.lit(", ',', ''), 'MMM d yyyy'), 'yyyy-MM-dd')"),
    )
    # what looks like a date and is none keeps its text
    named_dates = F.concat(named, F.lit(" AND "), to_iso, F.lit(" IS NOT NULL"))
    dates = FD.finding(
        "INCONSISTENT_FORMAT", "medium", F.when(F.col("slashed_dates") == 0, "green").otherwise("yellow"),
        "Dates are written in several ways",
        {"date_styles": "date_styles", **{s: s for s in shapes}},
        fix=FD.set_value(F.col("column"), named_dates, to_iso), investigation=named,
    )
    not_address = F.concat(
        F.lit("NOT "), name, F.lit(" RLIKE '" + X.EMAIL.replace("\\", "\\\\") + "'")
    )
    addresses = FD.finding(
        "INCONSISTENT_FORMAT", "medium", "yellow", "Some e-mail addresses are malformed",
        {"malformed": "malformed", "filled": "filled"},
        fix=FD.set_value(F.col("column"), not_address, "NULL"), investigation=not_address,
    )
    for_mail = F.lower("column").contains("email") | (
        F.col("addresses") >= F.col("filled") * F.lit(t.email_share)
    )
    return FD.emit(
        rows.where("texts > 0"),
        F.when(F.col("date_styles") >= 2, dates),
        F.when(for_mail & (F.col("malformed") > 0), addresses),
    )


def negative_findings(scan: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """NEGATIVE_VALUE: a few negatives among numbers that are otherwise not."""
    rows = scan.where("negatives > 0").withColumn("negative_share", F.col("negatives") / F.col("numbers"))
    predicate = F.concat(F.lit("try_cast("), FD.sql_name(F.col("column")), F.lit(" AS DOUBLE) < 0"))
    return FD.emit(
        rows.where(F.col("negative_share") < t.negative_share),
        FD.finding(
            "NEGATIVE_VALUE", "high", "yellow", "A few values are negative",
            {"negative_share": "negative_share", "negatives": "negatives", "numbers": "numbers"},
            fix=FD.set_value(F.col("column"), predicate, "NULL"), investigation=predicate,
        ),
    )


#: Spellings that a fix may name; beyond that a column gets none.
MOST_SPELLINGS = 500


def label_findings(
    tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]
) -> DataFrame | None:
    """INCONSISTENT_FORMAT: labels equal but for case or outer blanks.

    ``columns`` are the label columns, see :func:`label_columns`. Values are reduced to their
    distinct spellings before they are compared. The fix writes each label in its most frequent
    spelling (of equally frequent ones the first) and leaves labels of one spelling alone.
    """
    spelled = label_spellings(tables, columns)
    if spelled is None:
        return None
    label = ["table", "column", "folded", "folded_digest"]
    usual = F.min(F.struct((-F.col("rows")).alias("seldom"), "spelling", "spelling_digest")).alias("usual")
    labels = (
        spelled.groupBy(*label)
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("rows").alias("rows"), usual)
        .where("spellings > 1")
    )
    totals = labels.groupBy("table", "column").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("spellings").alias("spellings"), F.sum("rows").alias("rows")
    )
    several = labels.select(*[F.col(c).alias(f"its_{c}") for c in label], "usual")
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in label]
    others = spelled.join(several, same).where(
        (F.col("spelling") != F.col("usual.spelling")) | ~F.col("spelling_digest").eqNullSafe(F.col("usual.spelling_digest"))
    )
    place = F.row_number().over(Window.partitionBy("table", "column").orderBy("spelling", "spelling_digest"))
    long = F.col("spelling_digest").isNotNull() | F.col("usual.spelling_digest").isNotNull()
    named = (
        others.select("table", "column", "spelling", "spelling_digest", F.col("usual.spelling").alias("usual"), long.alias("long"))
        .withColumn("place", place)
        .where(F.col("place") <= MOST_SPELLINGS)
        .groupBy("table", "column")
        .agg(F.array_sort(F.collect_list(F.struct("spelling", "usual"))).alias("changes"), F.max("long").alias("any_long"))
    )
    rows = totals.join(F.broadcast(named), ["table", "column"])
    name = FD.sql_name(F.col("column"))
    quoted = lambda s: F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    listed = F.array_join(F.transform("changes", lambda c: quoted(c["spelling"])), ", ")
    pairs = F.array_join(F.transform("changes", lambda c: F.concat(quoted(c["spelling"]), F.lit(", "), quoted(c["usual"]))), ", ")
    # a column with more spellings, or long ones, is for a person to look at
    mapped = ~F.col("any_long") & (F.col("spellings") - F.col("labels") == F.size("changes"))
    predicate = F.concat(name, F.lit(" IN ("), listed, F.lit(")"))
    value = F.concat(F.lit("element_at(map("), pairs, F.lit("), "), name, F.lit(")"))
    folded = F.concat(name, F.lit(" <> lower(trim("), name, F.lit("))"))
    return FD.emit(
        rows,
        FD.finding(
            "INCONSISTENT_FORMAT", "medium", "yellow", "Labels differ only in case or blanks",
            {"labels": "labels", "spellings": "spellings", "rows": "rows"},
            fix=F.when(mapped, FD.set_value(F.col("column"), predicate, value)),
            investigation=F.when(mapped, predicate).otherwise(folded),
        ),
    )


def label_spellings(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame | None:
    """(table, column, spelling, folded, rows) and digests of long ones: distinct values of the columns."""
    parts, chosen = [], set(columns)
    for table, df in tables.items():
        names = [c for c in df.columns if (table, c) in chosen]
        if not names:
            continue
        data = df.select(*[column_ref(c).alias(f"c{i}") for i, c in enumerate(names)])
        spelled = (
            data.unpivot([], [f"c{i}" for i in range(len(names))], "site", "label")
            .where("label IS NOT NULL")
            .selectExpr("site", *_compact("label", "spelling"), *_compact("lower(trim(label))", "folded"))
        )
        spelled = spelled.groupBy(*spelled.columns).agg(F.count(F.lit(1)).alias("rows"))
        names_by_site = F.array(*[F.lit(n) for n in names])
        parts.append(
            spelled.select(
                F.lit(table).alias("table"),
                F.element_at(names_by_site, F.substring("site", 2, 9).cast("int") + 1).alias("column"),
                "spelling",
                "spelling_digest",
                "folded",
                "folded_digest",
                "rows",
            )
        )
    # distinct values, used more than once
    return settle(union_all(parts), bounded=False) if parts else None


def _compact(expression: str, name: str, inline: int = 128) -> list[str]:
    """A text as its beginning and, if that is not all of it, its digest."""
    return [
        f"left({expression}, {inline}) AS {name}",
        f"CASE WHEN length({expression}) > {inline} THEN sha2({expression}, 256) END AS {name}_digest",
    ]


def label_columns(profile: DataFrame, t: Thresholds = DEFAULT) -> list[tuple[str, str]]:
    """(table, column) of text columns that hold labels: bounded by the schema."""
    rows = profile.where(
        (F.col("declared_type") == "string")
        & (F.col("distinct_count") > 1)
        & (F.col("cardinality_ratio") <= t.label_ratio)
    ).select("table", "column")
    return [(r["table"], r["column"]) for r in rows.collect()]


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: repeated key values and the rows beyond the first of each."""
    keys = df.select(*[column_ref(c).alias(f"k{i}") for i, c in enumerate(key)]).dropna()
    return _repeats(keys.groupBy(*keys.columns))


def duplicate_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row: groups of rows equal on all columns but ``ignore``, and the excess rows."""
    data = positional(df)
    fixed, text = [], []
    for i, f in enumerate(df.schema.fields):
        if f.name in ignore:
            continue
        col = F.col(f"c{i}")
        if isinstance(f.dataType, T.StringType):
            text.append(f"c{i}")
        elif isinstance(f.dataType, T.BinaryType):
            text.append(f"base64(c{i})")  # JSON cannot carry bytes
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            text.append(X.rendered(f"c{i}", f.dataType))
        else:
            fixed.append(col.alias(f"f{i}"))
    if text:
        # Texts take part as one digest, so whole texts are never shuffled. JSON keeps
        # column boundaries and NULLs apart.
        whole = F.to_json(F.struct(*[F.expr(c).alias(f"t{j}") for j, c in enumerate(text)]))
        fixed.append(F.sha2(whole, 256).alias("digest"))
    rows = data.select(*fixed)
    return _repeats(rows.groupBy(*rows.columns))


def _repeats(grouped) -> DataFrame:
    counted = grouped.agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_row_findings(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame | None:
    """POSSIBLE_DUPLICATE: rows equal on everything but the key. Tables that are all key are left out."""
    keys = keys or {}
    counted = [
        duplicate_rows(df, keys.get(table, ())).select(F.lit(table).alias("table"), "*")
        for table, df in tables.items()
        if set(df.columns) - set(keys.get(table, ()))
    ]
    if not counted:
        return None
    return FD.emit(
        union_all(counted).where("duplicate_rows > 0"),
        FD.finding(
            "POSSIBLE_DUPLICATE", "medium", "red", "Rows repeat under different keys",
            {"duplicate_groups": "duplicate_groups", "duplicate_rows": "duplicate_rows"}, column=None,
        ),
    )


def composite_key_findings(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]
) -> DataFrame | None:
    """POSSIBLE_DUPLICATE for given keys of any width, counted over the table."""
    counted = [
        duplicate_keys(tables[table], key).select(
            F.lit(table).alias("table"), F.lit(", ".join(key)).alias("key"), "*"
        )
        for table, key in keys.items()
        if table in tables
    ]
    if not counted:
        return None
    rows = union_all(counted).where("duplicate_rows > 0")
    return FD.emit(
        rows,
        FD.finding(
            "POSSIBLE_DUPLICATE", "critical", "red", "Key values repeat",
            {"duplicate_groups": "duplicate_groups", "duplicate_rows": "duplicate_rows"}, column="key",
        ),
    )


def orphan_findings(tables: Mapping[str, DataFrame], relations: Sequence) -> DataFrame | None:
    """ORPHANED_FK for each relation (rows with from/to table and column)."""
    counted = [
        orphan_counts(tables[r["from_table"]], [r["from_column"]], tables[r["to_table"]], [r["to_column"]]).select(
            F.lit(r["from_table"]).alias("table"),
            F.lit(r["from_column"]).alias("column"),
            F.lit(r["to_table"]).alias("parent"),
            "*",
        )
        for r in relations
    ]
    if not counted:
        return None
    rows = union_all(counted).where("orphan_rows > 0")
    rate = F.col("orphan_rows") / F.col("referring_rows")
    return FD.emit(
        rows,
        FD.finding(
            "ORPHANED_FK", "high", "red", F.format_string("Values missing from %s", "parent"),
            {"orphan_rows": "orphan_rows", "orphan_values": "orphan_values", "orphan_rate": rate},
        ),
    )


def outlier_statistics(tables: Mapping[str, DataFrame], t: Thresholds = DEFAULT) -> DataFrame:
    """(table, column, n, mean, sd, p95, outliers) of columns with a value beyond the deviations.

    Columns whose extremes stay within the deviations are settled from their
    moments; only the others are searched for the percentile.
    """
    sites = column_sites(tables)
    rows = numbers.number_rows(tables, sites)
    limit = F.col("sd") * F.lit(t.outlier_deviations)
    far = settle(
        numbers.moments(rows).where(
            (F.col("hi") - F.col("mean") > limit) | (F.col("mean") - F.col("lo") > limit)
        )
    )
    # From here on only the columns in question are read: at most all of them.
    wanted = {r["cid"] for r in far.select("cid").collect()}
    rows = numbers.number_rows(
        tables, {table: [s for s in group if s.cid in wanted] for table, group in sites.items()}
    )
    percentiles = numbers.percentile_discrete(rows, far, t.outlier_quantile)
    bounds = settle(far.join(F.broadcast(percentiles), "cid"))
    extreme = (F.abs(F.col("x") - F.col("mean")) > limit) & (
        F.abs("x") > F.abs("percentile") * F.lit(t.outlier_ratio)
    )
    names = F.array(
        *[F.struct(F.lit(s.table).alias("table"), F.lit(s.name).alias("column")) for g in sites.values() for s in g]
    )
    return (
        rows.join(F.broadcast(bounds), "cid")
        .groupBy("cid", "n", "mean", "sd", "percentile")
        .agg(F.count_if(extreme).alias("outliers"))
        .withColumn("site", F.element_at(names, F.col("cid") + 1))
        .select("site.*", "n", "mean", "sd", F.col("percentile").alias("p95"), "outliers")
    )


def outlier_findings(tables: Mapping[str, DataFrame], t: Thresholds = DEFAULT) -> DataFrame:
    """OUTLIER: values both far from the mean and far beyond the upper percentile."""
    name = FD.sql_name(F.col("column"))
    beyond = F.concat(
        F.lit("abs(try_cast("), name, F.lit(" AS DOUBLE)) > abs("), F.col("p95").cast("string"),
        F.lit("D) * "), F.lit(str(t.outlier_ratio)),
    )
    return FD.emit(
        outlier_statistics(tables, t).where("outliers > 0"),
        FD.finding(
            "OUTLIER", "high", "red", "Values far outside the usual range",
            {"outliers": "outliers", "mean": "mean", "deviation": "sd", "p95": "p95"}, investigation=beyond,
        ),
    )


def formula_findings(
    tables: Mapping[str, DataFrame], formulas: Sequence[Formula], t: Thresholds = DEFAULT
) -> DataFrame | None:
    """FORMULA_DRIFT: rows that break a declared ``target = left * right``."""
    counted = []
    for f in formulas:
        df = tables[f.table]
        types = {x.name: x.dataType for x in df.schema.fields}
        target, left, right = (X.number(c, types[c]) for c in (f.target, f.left, f.right))
        counted.append(
            df.selectExpr(f"{target} - {left} * {right} AS gap").agg(
                F.count("gap").alias("checked"),
                F.count_if(F.abs("gap") > t.formula_tolerance).alias("violations"),
            )
            .select(
                F.lit(f.table).alias("table"), F.lit(f.target).alias("column"),
                F.lit(f.left).alias("left"), F.lit(f.right).alias("right"), "checked", "violations",
            )
        )
    if not counted:
        return None
    target, left, right = (FD.sql_name(F.col(c)) for c in ("column", "left", "right"))
    broken = F.format_string(
        f"abs(try_cast(%s AS DOUBLE) - try_cast(%s AS DOUBLE) * try_cast(%s AS DOUBLE)) > {t.formula_tolerance}",
        target, left, right,
    )
    value = F.format_string("round(try_cast(%s AS DOUBLE) * try_cast(%s AS DOUBLE), 2)", left, right)
    return FD.emit(
        union_all(counted).where("violations > 0"),
        FD.finding(
            "FORMULA_DRIFT", "high", "yellow", F.format_string("Differs from %s * %s", "left", "right"),
            {"violations": "violations", "checked": "checked"},
            fix=FD.set_value(F.col("column"), broken, value), investigation=broken,
        ),
    )


# --- all rules ----------------------------------------------------------------


def quality_findings(
    tables: Mapping[str, DataFrame],
    profile: DataFrame,
    relations: DataFrame | None = None,
    formulas: Sequence[Formula] = (),
    keys: Mapping[str, Sequence[str]] | None = None,
    t: Thresholds = DEFAULT,
) -> DataFrame:
    """Every quality finding of a source.

    ``profile`` and ``relations`` should be settled; their names (bounded by the
    schema) decide which columns the table rules read. ``keys`` overrides the
    keys found in the profile.
    """
    if keys is None:
        found = table_keys(profile, t).select("table", "key").collect()
        own_keys = {r["table"]: [r["key"]] for r in found}
        repeated = duplicate_key_findings(profile, t)
    else:
        own_keys, repeated = keys, composite_key_findings(tables, keys)
    scan = settle(value_scan(tables))
    parts = [
        null_findings(profile, t),
        type_findings(profile),
        own_key_findings(profile, t),
        repeated,
        format_findings(scan, t),
        negative_findings(scan, t),
        label_findings(tables, label_columns(profile, t)),
        duplicate_row_findings(tables, own_keys),
        outlier_findings(tables, t),
        formula_findings(tables, formulas, t),
    ]
    if relations is not None:
        parts.append(orphan_findings(tables, relations.collect()))
    return union_all([p for p in parts if p is not None])
