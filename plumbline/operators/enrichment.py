"""Enrichment rules: derivable, redundant and dependent columns, constraints, partitions.

Claims about all rows are never listed by brute force:

* ``c = a * b``      rows that cover all co-occurring columns refute claims, each product of such a row
                     looked up among its sorted values; what is left is checked on the whole table;
* ``a = b``          equal columns have equal fingerprints, taken of all columns in one pass;
* ``a determines b`` some values of each determinant refute claims; what is left is checked on the whole table, by one
                     grouped aggregate of the least and greatest hash of a determinant's dependents per value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.functions.types import is_numeric
from plumbline.operators import findings as FD
from plumbline.operators import products
from plumbline.operators.profile import positional
from plumbline.operators.unions import union_all
from plumbline.sources.catalog import describe_tables


@dataclass(frozen=True)
class Options:
    tolerance: float = 0.005
    probe_rows: int = 1000  # rows used to refute products; never to accept one
    probe_values: int = 256  # one in so many values, and one in so many rows,
    probe_share: int = 1024  # are used to refute dependencies; never to accept one
    partition_rows: int = 1_000_000  # a table this large is worth partitioning
    partition_values: int = 1000  # a partition column has at most this many values
    partition_fill: int = 1000  # and at least this many rows per value


DEFAULT = Options()


def _hash(value: str, seed: str | None = None) -> str:
    """SQL of a value's hash, NULL for NULL: different hashes mean different values."""
    more = f", '{seed}'" if seed else ""
    return f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}{more}) END"


def _usable(df: DataFrame, constant: Sequence[str]) -> list[int]:
    return [i for i, f in enumerate(df.schema.fields) if f.name not in constant]


# --- c = a * b ------------------------------------------------------------------


def derivable_columns(
    df: DataFrame, constant: Sequence[str] = (), options: Options = DEFAULT
) -> DataFrame:
    """(target, left, right, checked): products that hold on every complete row.

    Constant columns take no part: multiplying by one explains nothing.
    """
    numeric = [i for i in _usable(df, constant) if is_numeric(df.schema.fields[i].dataType)]
    if len(numeric) < 3:
        return _confirmed(df, df, [], lambda _: None, ("target", "left", "right"))
    sql = {i: X.number(f"c{i}", df.schema.fields[i].dataType) for i in numeric}
    data = positional(df)
    rows, complete = _refuting_rows(data, list(sql.values()), options)
    left = products.surviving(rows, options.tolerance)
    if not complete:
        left += products.unseen(rows)
    claims = [tuple(numeric[x] for x in claim) for claim in left]
    number = {i: F.expr(e) for i, e in sql.items()}

    def evidence(claim: tuple[int, ...]) -> Column:
        c, a, b = claim
        return F.abs(number[c] - number[a] * number[b]) <= F.lit(options.tolerance)

    return _confirmed(df, data, claims, evidence, ("target", "left", "right"))


def _refuting_rows(data: DataFrame, numbers: Sequence[str], options: Options):
    """At most ``2 * probe_rows`` rows of numbers, NaN for NULL: some of the first ones, and one for each
    other set of columns that are filled together; and whether these are all such sets."""
    filled = F.concat(*[F.when(F.expr(e).isNull(), "0").otherwise("1") for e in numbers])
    rows = data.select(filled.alias("filled"), F.expr(f"array({', '.join(numbers)})").alias("numbers"))
    first = rows.limit(options.probe_rows).collect()
    known = sorted({r["filled"] for r in first})
    sets = rows.groupBy("filled").count()
    if known:
        sets = sets.where(~F.col("filled").isin(known))
    others = [r["filled"] for r in sets.orderBy(F.desc("count"), "filled").limit(options.probe_rows + 1).collect()]
    complete, others = len(others) <= options.probe_rows, others[: options.probe_rows]
    if others:
        wanted = F.broadcast(data.sparkSession.createDataFrame([(x,) for x in others], "filled string"))
        first += rows.join(wanted, "filled").groupBy("filled").agg(F.any_value("numbers").alias("numbers")).collect()
    return products.as_matrix([r["numbers"] for r in first], len(numbers)), complete


# --- a = b -----------------------------------------------------------------------


def redundant_pairs(
    df: DataFrame, constant: Sequence[str] = (), options: Options = DEFAULT
) -> DataFrame:
    """(kept, copy, checked): columns of one type that are equal, NULLs included, on every row."""
    fields = df.schema.fields
    by_type: dict[T.DataType, list[int]] = {}
    for i in _usable(df, constant):
        if _orderable(fields[i].dataType):
            by_type.setdefault(fields[i].dataType, []).append(i)
    compared = [i for members in by_type.values() if len(members) > 1 for i in members]
    data = positional(df)
    prints = fingerprints(data, {i: fields[i].dataType for i in compared})
    claims = [
        (a, b) for members in by_type.values() for a, b in combinations(members, 2)
        if prints.get(a) is not None and prints[a] == prints.get(b)
    ]
    return _confirmed(
        df, data, sorted(claims), lambda p: F.col(f"c{p[0]}").eqNullSafe(F.col(f"c{p[1]}")), ("kept", "copy")
    )


def fingerprints(data: DataFrame, columns: Mapping[int, T.DataType]) -> dict[int, int | None]:
    """A number per column of :func:`positional` rows, alike for columns that are equal on every row.

    Each value is hashed together with a mark of its row, and the hashes are combined without
    regard to order, so that it takes one aggregate over all columns. NULL without rows."""
    if not columns:
        return {}
    # adding zero makes the two zeros of floating point one, as equality does
    plus = {i: " + 0" if isinstance(t, (T.FloatType, T.DoubleType)) else "" for i, t in columns.items()}
    marked = data.withColumn("row", F.monotonically_increasing_id())
    hashed = marked.selectExpr(*[f"xxhash64(row, c{i}{plus[i]}) AS c{i}" for i in columns])
    found = hashed.agg(*[F.bit_xor(f"c{i}").alias(f"c{i}") for i in columns]).first()
    return {i: found[f"c{i}"] for i in columns}


def _orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _confirmed(df, data, claims, evidence, names, width: int = 200) -> DataFrame:
    """Claims without a counter-example on the whole table, and the rows that bear them out."""
    schema = ", ".join(f"{n} string" for n in names) + ", checked bigint"
    if not claims:
        return df.sparkSession.createDataFrame([], schema)
    blocks = []
    for start in range(0, len(claims), width):
        aggregates, entries = [], []
        for j, claim in enumerate(claims[start : start + width]):
            holds = evidence(claim)
            aggregates += [F.count_if(~holds).alias(f"broken{j}"), F.count(holds).alias(f"checked{j}")]
            labels = [F.lit(df.schema.fields[i].name).alias(n) for i, n in zip(claim, names)]
            entries.append(
                F.struct(*labels, F.col(f"checked{j}").alias("checked"), F.col(f"broken{j}").alias("broken"))
            )
        blocks.append(data.agg(*aggregates).select(F.inline(F.array(*entries))))
    return union_all(blocks).where("broken = 0 AND checked > 0").drop("broken")


# --- a determines b ---------------------------------------------------------------


_DEPENDENCY = "determinant string, dependent string, `values` bigint"


def dependencies(
    df: DataFrame,
    determinants: Sequence[str],
    dependents: Sequence[str],
    options: Options = DEFAULT,
    width: int = 64,
) -> DataFrame:
    """(determinant, dependent, values): pairs where each left value has one right value.

    Rows missing either value take no part. Some of the rows refute most pairs. For what is left, every row
    meets the groups of its values of all determinants, and each group keeps the least and greatest hash of
    the determinant's own dependents: they differ where a second value comes in. ``width`` dependents are
    aggregated together.
    """
    determinants, dependents = list(dict.fromkeys(determinants)), list(dict.fromkeys(dependents))
    blocks = [dependents[i : i + width] for i in range(0, len(dependents), width)]
    claims = [{a: [b for b in block if b != a] for a in determinants} for block in blocks]
    claims = [{a: own for a, own in c.items() if own} for c in claims]
    refuted = {tuple(r) for r in _refuted(df, [c for c in claims if c], options)}
    claims = [{a: [b for b in own if (a, b) not in refuted] for a, own in c.items()} for c in claims]
    claims = [{a: own for a, own in c.items() if own} for c in claims]
    parts = [_grouped(df, c) for c in claims if c]
    if not parts:
        return df.sparkSession.createDataFrame([], _DEPENDENCY)
    held = union_all(parts).where("dependent IS NOT NULL AND broken = 0 AND `values` > 0")
    return held.select("determinant", "dependent", "values")


def _refuted(df: DataFrame, claims: Sequence[Mapping[str, list[str]]], options: Options) -> list:
    """Pairs that do not hold for some of the determinants' values, taken with all their rows, or among
    some of the rows. Both are chosen by hash, so that neither order nor place of rows decides."""
    some = f"pmod(x, {options.probe_values}) = 0 OR pmod(mark, {options.probe_share}) = 0"
    parts = [_grouped(df, c, some).where("dependent IS NOT NULL AND broken > 0").select("determinant", "dependent") for c in claims]
    return union_all(parts).collect() if parts else []


def _value(df: DataFrame, column: str) -> tuple[str, str]:
    """SQL of two numbers that stand for a value, NULL for NULL. Of a type of fixed width the first is enough, as
    its hash is another number for each value; of other ones no two of very many may meet by chance in both."""
    i = df.columns.index(column)
    dtype, at = df.schema.fields[i].dataType, f"c{i}"
    if isinstance(dtype, (T.IntegralType, T.DateType, T.BooleanType)):
        return _hash(at), "0L"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):  # the two zeros hash alike
        return f"CASE WHEN {at} = 0 AND CAST({at} AS STRING) LIKE '-%' THEN -1L ELSE {_hash(at)} END", "0L"
    shown = X.rendered(at, dtype)
    return _hash(shown), _hash(shown, "site")


def _grouped(df: DataFrame, claims: Mapping[str, list[str]], some: str | None = None) -> DataFrame:
    """(determinant, dependent, values, broken) of each determinant's dependents: its values that have one,
    and those that have several. ``some`` chooses among the rows that meet groups."""
    dependents = list(dict.fromkeys(b for own in claims.values() for b in own))
    place = {b: j for j, b in enumerate(dependents)}
    slots = max(len(own) for own in claims.values())
    hashes = [f"{_value(df, b)[0]} AS h{j}" for j, b in enumerate(dependents)]
    values = []
    for i, (a, own) in enumerate(claims.items()):
        x, y = _value(df, a)
        kept = [f"h{place[own[j]]}" if j < len(own) else "CAST(NULL AS BIGINT)" for j in range(slots)]
        values.append(f"named_struct('site', {i}, 'x', {x}, 'y', {y}, {', '.join(f'{chr(39)}d{j}{chr(39)}, {h}' for j, h in enumerate(kept))})")
    mark = f"xxhash64({', '.join(f'h{j}' for j in range(len(dependents)))}) AS mark" if some else "0 AS mark"
    rows = positional(df).selectExpr("*", *hashes).selectExpr(mark, f"inline(array({', '.join(values)}))").where("x IS NOT NULL")
    rows = rows.where(some) if some else rows
    extremes = [f(F.col(f"d{j}")).alias(f"{n}{j}") for j in range(slots) for n, f in (("lo", F.min), ("hi", F.max))]
    groups = rows.groupBy("site", "x", "y").agg(*extremes)
    verdicts = [
        x for j in range(slots)
        for x in (F.count_if(F.col(f"lo{j}") != F.col(f"hi{j}")).alias(f"broken{j}"), F.count(f"lo{j}").alias(f"values{j}"))
    ]

    def name(names: Sequence[str | None]) -> Column:
        return F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), F.col("site") + 1)

    entries = [
        F.struct(
            name(list(claims)).alias("determinant"),
            name([own[j] if j < len(own) else None for own in claims.values()]).alias("dependent"),
            F.col(f"values{j}").alias("values"),
            F.col(f"broken{j}").alias("broken"),
        )
        for j in range(slots)
    ]
    return groups.groupBy("site").agg(*verdicts).select(F.inline(F.array(*entries)))


# --- findings ------------------------------------------------------------------------


def _lifted(rows: DataFrame, table: str, finding: Column) -> DataFrame:
    return FD.emit(rows.withColumn("table", F.lit(table)), finding)


def table_findings(
    table: str, df: DataFrame, facts: Mapping[str, Mapping], options: Options = DEFAULT
) -> list[DataFrame]:
    """DERIVABLE_COLUMN, REDUNDANT_COLUMN (copies) and NORMALIZATION_OPPORTUNITY of one table.

    ``facts`` are the table's profile rows by column name.
    """
    constant = [c for c, p in facts.items() if p["distinct_count"] <= 1]
    determinants = [c for c, p in facts.items() if p["distinct_count"] > 1 and p["cardinality_ratio"] < 1.0]
    dependents = [c for c, p in facts.items() if p["distinct_count"] > 1]
    product = FD.finding(
        "DERIVABLE_COLUMN", "medium", "red", F.format_string("%s = %s * %s", "target", "left", "right"),
        {"checked": "checked"}, column="target", kind=FD.ENRICHMENT,
    )
    copy = FD.finding(
        "REDUNDANT_COLUMN", "low", "red", F.format_string("%s repeats %s", "copy", "kept"),
        {"checked": "checked"}, column="copy", kind=FD.ENRICHMENT,
    )
    depends = FD.finding(
        "NORMALIZATION_OPPORTUNITY", "medium", "red", F.format_string("%s determines %s", "determinant", "dependent"),
        {"distinct_values": "values"}, column="dependent", kind=FD.ENRICHMENT,
    )
    return [
        _lifted(derivable_columns(df, constant, options), table, product),
        _lifted(redundant_pairs(df, constant, options), table, copy),
        _lifted(dependencies(df, determinants, dependents, options), table, depends),
    ]


def profile_findings(
    profile: DataFrame, schema: DataFrame | None = None, options: Options = DEFAULT
) -> DataFrame:
    """Constant columns, constraint candidates and partition candidates, from the profile.

    ``schema`` (table, column, nullable) limits NOT NULL candidates to nullable columns.
    """
    rows = profile.where("row_count > 0")
    if schema is None:
        rows = rows.withColumn("nullable", F.lit(True))
    else:
        rows = rows.join(F.broadcast(schema.select("table", "column", "nullable")), ["table", "column"], "left")
    full = F.col("null_count") == 0
    distinct, count = F.col("distinct_count"), F.col("row_count")
    kind = {"kind": FD.ENRICHMENT}
    constant = FD.finding(
        "REDUNDANT_COLUMN", "low", "red", "Holds a single value", {"distinct_count": "distinct_count"}, **kind
    )
    required = FD.finding(
        "MISSING_CONSTRAINT", "low", "red", "NOT NULL would hold", {"null_count": "null_count"}, **kind
    )
    unique = FD.finding(
        "MISSING_CONSTRAINT", "medium", "red", "UNIQUE would hold", {"distinct_count": "distinct_count"}, **kind
    )
    partition = FD.finding(
        "PARTITION_OPPORTUNITY", "low", "red", "Few values, or time, on a large table",
        {"distinct_count": "distinct_count", "row_count": "row_count"}, **kind,
    )
    temporal = F.col("inferred_type").isin("date", "datetime")
    few = (distinct > 1) & (distinct <= options.partition_values) & (count / distinct >= options.partition_fill)
    return FD.emit(
        rows,
        F.when(full & (distinct == 1) & (count > 1), constant),
        F.when(full & F.col("nullable"), required),
        F.when((F.col("cardinality_ratio") == 1.0) & (count > 1), unique),
        F.when((count >= options.partition_rows) & (temporal | few), partition),
    )


def enrichment_findings(
    tables: Mapping[str, DataFrame], profile: DataFrame, options: Options = DEFAULT
) -> DataFrame:
    """Every enrichment finding of a source; ``profile`` should be settled."""
    facts: dict[str, dict] = {t: {} for t in tables}
    for r in profile.select("table", "column", "distinct_count", "cardinality_ratio").collect():
        if r["table"] in facts:
            facts[r["table"]][r["column"]] = r.asDict()
    parts = [profile_findings(profile, describe_tables(tables), options=options)]
    for table, df in tables.items():
        parts += table_findings(table, df, facts[table], options)
    return union_all(parts)


def best(findings: DataFrame, n: int = 5) -> DataFrame:
    """The n most severe enrichment findings."""
    rank = F.array_position(F.array(*[F.lit(s) for s in FD.SEVERITIES]), F.col("severity"))
    return findings.orderBy(rank, "code", F.col("tables")[0], "column", "description").limit(n)


