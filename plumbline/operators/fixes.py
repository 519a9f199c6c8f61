"""Typed fixes: dry run, disposition, application.

A fix is a Spark SQL predicate with a new value, or a predicate of rows to drop.
Tables are immutable, so a dry run is a count of the matching rows, and applying
fixes builds one narrow plan over the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.types import column_ref
from plumbline.operators import findings as FD

RESULT_SCHEMA = (
    "seq int, `table` string, `column` string, passed boolean, estimated_rows_affected bigint, "
    "error string, disposition string"
)


@dataclass(frozen=True)
class Fix:
    """``set`` writes ``value`` (an expression) into ``column`` where ``predicate``
    holds; ``drop_rows`` removes those rows."""

    table: str
    column: str
    predicate: str
    value: str | None = None
    action: str = "set"
    risk: str = "green"

    def apply(self, df: DataFrame) -> DataFrame:
        hit = F.expr(self.predicate)
        if self.action == "drop_rows":
            return df.where(~F.coalesce(hit, F.lit(False)))
        if self.action != "set":
            raise ValueError(f"unknown action {self.action!r}")
        if self.column not in df.columns:
            raise ValueError(f"table {self.table} has no column {self.column!r}")
        kept = column_ref(self.column)
        # the new value takes the column's type, never the column the value's
        new = F.expr(self.value if self.value is not None else "NULL")
        changed = F.when(hit, new.try_cast(df.schema[self.column].dataType)).otherwise(kept)
        return df.select(*[(changed if c == self.column else column_ref(c)).alias(c) for c in df.columns])

    def matches(self) -> Column:
        """Number of rows the predicate matches, as an aggregate.

        The new value is evaluated for those rows as well, so an expression
        that fails on the data fails the dry run.
        """
        hit = F.expr(self.predicate)
        if self.action == "set" and self.value is not None:
            return F.count(F.when(hit, F.xxhash64(F.expr(self.value))))
        return F.count_if(hit)

    def loses(self, df: DataFrame) -> Column:
        """Not NULL in rows whose new value the column's type cannot hold. The value is
        computed only where the predicate holds: nested, as AND may compute both sides."""
        if self.action != "set" or self.value is None:
            return F.lit(None).cast("int")
        new = F.expr(self.value)
        stored = new.try_cast(df.schema[self.column].dataType)
        return F.when(F.expr(self.predicate), F.when(new.isNotNull() & stored.isNull(), F.lit(1)))

    def lost(self, df: DataFrame) -> Column:
        """Number of new values that the column's type cannot hold, as an aggregate."""
        return F.count(self.loses(df))


@dataclass(frozen=True)
class Outcome:
    seq: int
    table: str
    column: str
    passed: bool
    estimated_rows_affected: int | None
    error: str | None
    disposition: str


def _short(error: Exception) -> str:
    return str(error).splitlines()[0][:300]


def _losses(df: DataFrame, fixes: Sequence[Fix], chain: Sequence[int]) -> list[int]:
    """New values that each fix of ``chain`` would lose where earlier ones have changed the
    rows. Evaluates every value the chain sets; raises if one fails on the data."""
    columns, mark = df.columns, "lost"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    for s in chain:
        df = fixes[s].apply(df.withColumn(f"{mark}{s}", fixes[s].loses(df)))
    written = [column_ref(c) for c in columns if c in {fixes[s].column for s in chain if fixes[s].action == "set"}]
    # a maximum, since a count of hashes does not evaluate them
    done = df.agg(*[F.count(f"{mark}{s}") for s in chain], F.max(F.xxhash64(*written or [F.lit(0)]))).first()
    return list(done[: len(chain)])


def _culprits(df: DataFrame, fixes: Sequence[Fix], chain: list[int]) -> dict[int, Exception]:
    """Fixes that fail only after earlier ones.

    One pass over the whole chain marks what each fix loses; as those before the first loser
    are right, it is a culprit, and the pass is repeated without it. If the pass itself fails on the
    data, the shortest failing beginning of the chain, found by halving, ends with a culprit. So the
    number of passes goes by the culprits, not by the chain's length.
    """
    found: dict[int, Exception] = {}
    chain = list(chain)
    while len(chain) + len(found) > 1 and chain:
        try:
            lost = _losses(df, fixes, chain)
        except (PySparkException, ValueError) as error:
            culprit = _first_failing(df, fixes, chain)
            found[culprit] = error
        else:
            if not any(lost):
                break
            culprit = next(s for s, n in zip(chain, lost) if n)
            number = lost[chain.index(culprit)]
            found[culprit] = ValueError(f"{number} new values do not fit the type of {fixes[culprit].column!r} after earlier fixes")
        chain.remove(culprit)
    return found


def _first_failing(df: DataFrame, fixes: Sequence[Fix], chain: Sequence[int]) -> int:
    """The last fix of the shortest beginning of ``chain`` that fails on the data."""
    runs, fails = 0, len(chain)
    while fails - runs > 1:
        middle = (runs + fails) // 2
        try:
            _losses(df, fixes, chain[:middle])
            runs = middle
        except (PySparkException, ValueError):
            fails = middle
    return chain[fails - 1]


def dry_run(tables: Mapping[str, DataFrame], fixes: Sequence[Fix]) -> list[Outcome]:
    """Outcome of each fix against the untouched tables.

    Fixes that do not fit their table fail without reading it. The others of a
    table are counted in one pass; if that pass fails on the data, each is
    counted alone so that only the culprits fail. Green fixes of a table that pass
    are then tried one after another, as ``apply_fixes`` will run them.
    """
    outcomes: dict[int, Outcome] = {}

    def passed(seq: int, affected: int) -> Outcome:
        return Outcome(seq, fixes[seq].table, fixes[seq].column, True, affected, None, "keep")

    def failed(seq: int, error: Exception) -> Outcome:
        return Outcome(seq, fixes[seq].table, fixes[seq].column, False, None, _short(error), "drop")

    def judged(seq: int, affected: int, lost: int) -> Outcome:
        if lost:
            return failed(seq, ValueError(f"{lost} new values do not fit the type of {fixes[seq].column!r}"))
        return passed(seq, affected)

    ready: dict[str, list[int]] = {}
    for seq, fix in enumerate(fixes):
        try:
            fix.apply(tables[fix.table]).schema
            tables[fix.table].agg(fix.matches()).schema
            ready.setdefault(fix.table, []).append(seq)
        except (PySparkException, ValueError, KeyError) as error:
            outcomes[seq] = failed(seq, error)

    for table, group in ready.items():
        try:
            tests = [c for s in group for c in (fixes[s].matches().alias(f"n{s}"), fixes[s].lost(tables[table]).alias(f"lost{s}"))]
            counts = tables[table].agg(*tests).first()
            outcomes |= {s: judged(s, counts[f"n{s}"], counts[f"lost{s}"]) for s in group}
        except PySparkException:
            for s in group:
                try:
                    outcomes[s] = judged(s, *tables[table].agg(fixes[s].matches(), fixes[s].lost(tables[table])).first())
                except PySparkException as error:
                    outcomes[s] = failed(s, error)
        chain = [s for s in group if fixes[s].risk == "green" and outcomes[s].passed]
        for s, error in _culprits(tables[table], fixes, chain).items():
            outcomes[s] = failed(s, error)
    return [outcomes[s] for s in range(len(fixes))]


def outcomes_frame(spark, outcomes: Sequence[Outcome]) -> DataFrame:
    rows = [
        (o.seq, o.table, o.column, o.passed, o.estimated_rows_affected, o.error, o.disposition) for o in outcomes
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def apply_fixes(
    df: DataFrame, table: str, fixes: Sequence[Fix], outcomes: Sequence[Outcome]
) -> DataFrame:
    """The table after its green fixes that passed, in order; later ones see earlier ones.

    A fix that no longer fits is skipped.
    """
    for fix, outcome in zip(fixes, outcomes):
        if fix.table != table or fix.risk != "green" or not outcome.passed:
            continue
        try:
            df = fix.apply(df)
        except (PySparkException, ValueError):
            continue
    return df


def investigate(df: DataFrame, predicate: str, order_by: Sequence[str], n: int = 100) -> DataFrame:
    """The first offending rows, for a person to look at."""
    return df.where(F.expr(predicate)).orderBy(*order_by).limit(n)


# --- findings ---------------------------------------------------------------------


def identified(findings: DataFrame) -> DataFrame:
    """Findings with a stable ``finding_id``: their content decides it, not their order."""
    parts = [
        "kind", "code", F.array_join("tables", ","), F.coalesce("column", F.lit("")),
        F.coalesce("description", F.lit("")),
    ]
    return findings.withColumn("finding_id", F.sha2(F.concat_ws("\u001f", *parts), 256))


def runnable(findings: DataFrame) -> list[tuple[str, Fix]]:
    """(finding_id, fix) of findings with a fix that is not advisory: bounded by the schema."""
    rows = (
        identified(findings)
        .where((F.col("fix_risk") != "red") & F.col("fix").isNotNull())
        .orderBy(F.desc("kind"), F.col("tables")[0], F.col("column"), "code", "description", "finding_id")
        .select("finding_id", F.col("tables")[0].alias("table"), "fix_risk", "fix.*")
        .collect()
    )
    return [
        (
            r["finding_id"],
            Fix(r["table"], r["column"], r["predicate"], r["value"], r["action"], r["fix_risk"]),
        )
        for r in rows
    ]


def dispose(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Findings after their dry runs.

    ``results`` has finding_id and the dry-run fields. A failed fix is cleared; a
    failed green quality finding becomes yellow, an enrichment finding keeps its
    risk. Advisory findings and findings without a fix are left alone.
    """
    outcome = F.struct("passed", "estimated_rows_affected", "error", "disposition").cast(FD.DRY_RUN)
    results = results.select("finding_id", outcome.alias("outcome"))
    tried = (F.col("fix_risk") != "red") & F.col("fix").isNotNull() & F.col("outcome").isNotNull()
    failed = tried & ~F.col("outcome.passed")
    downgraded = failed & (F.col("kind") == FD.QUALITY) & (F.col("fix_risk") == "green")
    joined = identified(findings).join(F.broadcast(results), "finding_id", "left")
    return joined.select(
        *[c for c in FD.COLUMNS if c not in ("fix_risk", "fix", "dry_run")],
        F.when(downgraded, "yellow").otherwise(F.col("fix_risk")).alias("fix_risk"),
        F.when(~failed, F.col("fix")).alias("fix"),
        F.when(tried, F.col("outcome")).otherwise(F.col("dry_run")).alias("dry_run"),
    ).select(*FD.COLUMNS)


def validate(tables: Mapping[str, DataFrame], findings: DataFrame) -> tuple[DataFrame, list[Fix], list[Outcome]]:
    """Dry-run every runnable fix of ``findings`` (settled) and dispose of them."""
    pairs = runnable(findings)
    fixes = [fix for _, fix in pairs]
    outcomes = dry_run(tables, fixes)
    spark = findings.sparkSession
    rows = [
        (finding_id, o.passed, o.estimated_rows_affected, o.error, o.disposition)
        for (finding_id, _), o in zip(pairs, outcomes)
    ]
    schema = "finding_id string, passed boolean, estimated_rows_affected bigint, error string, disposition string"
    return dispose(findings, spark.createDataFrame(rows, schema)), fixes, outcomes
