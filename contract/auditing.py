"""Registered queries: quality and enrichment findings, fixes, reports, redaction."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import profile_sql as S
from contract.profiling import inputs
from contract.relating import KEYS
from contract.views import VIEWS, load
from plumbline import profile_tables
from plumbline.functions.types import catalog_label
from plumbline.operators import enrichment as E
from plumbline.operators import findings as FD
from plumbline.operators import fixes as FX
from plumbline.operators import quality as Q
from plumbline.operators import redaction
from plumbline.operators.inquiries import offending_rows
from plumbline.operators.profile import rounded, top_values
from plumbline.plans import report as RP
from plumbline.plans.audit import audit
from plumbline.sources import files
from plumbline.sources.catalog import describe_tables
from plumbline.sources.settle import settle

AUDITED = ["intake", "passages", "customers", "sales"]
FORMULAS = [Q.Formula("intake", "line_total", "quantity", "price")]


def profiled(spark, sf_dir, names=AUDITED):
    tables = inputs(spark, sf_dir, names)
    return tables, settle(profile_tables(tables))


def flat(findings: DataFrame, *evidence: str) -> DataFrame:
    """Findings with one column per evidence entry."""
    return findings.select(
        "code",
        F.array_join("tables", ",").alias("table"),
        "column",
        "severity",
        "fix_risk",
        *[F.try_element_at("evidence", F.lit(e)).alias(e) for e in evidence],
    )


def _row(code, table, column, severity, risk, **evidence) -> str:
    cells = [f"'{code}' AS code", f"{table} AS \"table\"", f"{column} AS \"column\""]
    cells += [f"{severity} AS severity", f"{risk} AS fix_risk"]
    cells += [f"CAST({v} AS DOUBLE) AS {k}" for k, v in evidence.items()]
    return "SELECT " + ", ".join(cells)


# --- SQL of the rules over profiles -------------------------------------------------

_T, _C = '"table"', '"column"'
_NULLS = f"""SELECT CASE WHEN null_pct = 1 THEN 'ALL_NULL' WHEN null_pct >= 0.5 THEN 'NULL_CRITICAL'
        ELSE 'NULL_EXCESS' END AS code, "table", "column",
    CASE WHEN null_pct >= 0.5 THEN 'critical' WHEN null_pct >= 0.2 THEN 'high'
         WHEN null_pct >= 0.05 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN null_pct >= 0.5 THEN 'red' ELSE 'yellow' END AS fix_risk,
    null_pct, CAST(null_count AS DOUBLE) AS null_count, CAST(row_count AS DOUBLE) AS row_count
    FROM profile WHERE null_pct > 0"""
_MISMATCH = _row("TYPE_MISMATCH", _T, _C, "'high'", "'red'", distinct_count="distinct_count") + (
    " FROM profile WHERE flags LIKE '%type_mismatch%'"
)
_MIXED = _row("MIXED_TYPES", _T, _C, "'high'", "'red'", distinct_count="distinct_count") + (
    " FROM profile WHERE flags LIKE '%mixed_types%'"
)
_OWN_KEY = _row(
    "CARDINALITY_ANOMALY", _T, _C, "'medium'", "'red'",
    cardinality_ratio="cardinality_ratio", distinct_count="distinct_count",
) + """ FROM profile WHERE row_count > null_count AND cardinality_ratio < 0.98
      AND lower("column") IN ('id', "table" || '_id', regexp_replace("table", 's$', '') || '_id')"""  # fmt: skip
_DUPLICATE_KEY = (
    _row(
        "POSSIBLE_DUPLICATE", _T, "k.key", "'critical'", "'red'",
        duplicate_rows="row_count - null_count - distinct_count", row_count="row_count",
    )
    + """ FROM profile JOIN (SELECT "table" AS kt, arg_min("column", ordinal) AS key FROM profile
        WHERE (lower("column") = 'id' OR lower("column") LIKE '%\\_id' ESCAPE '\\') AND cardinality_ratio >= 0.9
        GROUP BY 1) k ON kt = "table" AND k.key = "column"
      WHERE distinct_count < row_count - null_count"""
)


def _over_profiles(body: str, names=AUDITED) -> str:
    return S.with_ctes(S.all_profiles_cte(names), body)


# --- SQL of the rules over values ---------------------------------------------------

NAMED = r"^[A-Z][a-z]{2} [0-9]{1,2},? [0-9]{4}\z"
SLASHED = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\z"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"


def _texts(names) -> list[tuple[str, str]]:
    return [(v, c) for v in names for c, k in VIEWS[v].columns if k == "string"]


def _measures(names) -> list[tuple[str, str, str]]:
    return [(v, c, k) for v in names for c, k in VIEWS[v].columns if k in ("string", "bigint", "int", "double")]


def _formats_sql(names) -> str:
    counts = " UNION ALL ".join(
        f"""SELECT '{v}' AS t, '{c}' AS c, count({c}) AS filled,
            count(*) FILTER (regexp_matches({c}, '{S.ISO_DATE}')) AS iso,
            count(*) FILTER (regexp_matches({c}, '{NAMED}')) AS named,
            count(*) FILTER (regexp_matches({c}, '{SLASHED}')) AS slashed,
            count(*) FILTER (regexp_matches({c}, '{EMAIL}')) AS mails FROM ({VIEWS[v].sql})"""
        for v, c in _texts(names)
    )
    styles = "(iso > 0)::INT + (named > 0)::INT + (slashed > 0)::INT"
    dates = _row(
        "INCONSISTENT_FORMAT", "t", "c", "'medium'", "CASE WHEN slashed = 0 THEN 'green' ELSE 'yellow' END",
        date_styles=styles, malformed="NULL",
    )
    mails = _row(
        "INCONSISTENT_FORMAT", "t", "c", "'medium'", "'yellow'", date_styles="NULL", malformed="filled - mails"
    )
    return f"""WITH counts AS ({counts}) {dates} FROM counts WHERE {styles} >= 2 UNION ALL
        {mails} FROM counts WHERE (c LIKE '%email%' OR mails >= filled * 0.5) AND filled > mails"""


def _labels_sql(names) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{v}' AS t, '{c}' AS c, lower(trim({c})) AS folded, count(DISTINCT {c}) AS spellings,
            count(*) AS n FROM ({VIEWS[v].sql}) WHERE {c} IS NOT NULL
            AND (SELECT count(DISTINCT {c}) FROM ({VIEWS[v].sql})) > 1
            AND (SELECT count(DISTINCT {c}) / count({c}) FROM ({VIEWS[v].sql})) <= 0.5 GROUP BY folded"""
        for v, c in _texts(names)
    )
    return f"""WITH folded AS ({parts}) """ + _row(
        "INCONSISTENT_FORMAT", "t", "c", "'medium'", "'yellow'",
        labels="count(*)", spellings="sum(spellings)", rows="sum(n)",
    ) + " FROM folded WHERE spellings > 1 GROUP BY t, c"


def _numbers_cte(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS t, '{c}' AS c, {S.number(c, k)} AS x FROM ({VIEWS[v].sql})" for v, c, k in _measures(names)
    )


def _negatives_sql(names, share=0.05) -> str:
    return f"WITH numbers AS ({_numbers_cte(names)}) " + _row(
        "NEGATIVE_VALUE", "t", "c", "'high'", "'yellow'",
        negative_share="count(*) FILTER (x < 0) / count(x)", negatives="count(*) FILTER (x < 0)",
    ) + f""" FROM numbers GROUP BY t, c HAVING count(*) FILTER (x < 0) > 0
           AND count(*) FILTER (x < 0) / count(x) < {share}"""  # fmt: skip


def _outliers_sql(names, ratio=10.0, body=None) -> str:
    return f"""WITH numbers AS (SELECT * FROM ({_numbers_cte(names)}) WHERE x IS NOT NULL),
        facts AS (SELECT t, c, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd,
                         quantile_disc(x, 0.95) AS p95, min(x) AS lo, max(x) AS hi FROM numbers GROUP BY t, c),
        hits AS (SELECT t, c, n, mean, sd, p95,
                   count(*) FILTER (abs(x - mean) > 3 * sd AND abs(x) > {ratio} * abs(p95)) AS outliers
                 FROM numbers JOIN facts USING (t, c) WHERE hi - mean > 3 * sd OR mean - lo > 3 * sd
                 GROUP BY ALL) """ + (
        body
        or _row("OUTLIER", "t", "c", "'high'", "'red'", outliers="outliers", p95="p95") + " FROM hits WHERE outliers > 0"
    )


def _duplicate_rows_sql(names, keys) -> str:
    parts = []
    for v in names:
        cols = [c for c, _ in VIEWS[v].columns if c != keys.get(v)]
        parts.append(
            f"""SELECT '{v}' AS t, count(*) AS g, coalesce(sum(n - 1), 0) AS d FROM
            (SELECT count(*) AS n FROM ({VIEWS[v].sql}) GROUP BY {', '.join(cols)}) WHERE n > 1"""
        )
    return f"WITH d AS ({' UNION ALL '.join(parts)}) " + _row(
        "POSSIBLE_DUPLICATE", "t", "CAST(NULL AS VARCHAR)", "'medium'", "'red'",
        duplicate_groups="g", duplicate_rows="d",
    ) + " FROM d WHERE d > 0"


def _orphans_sql() -> str:
    parent = f"SELECT id FROM ({VIEWS['customers'].sql}) WHERE id >= 100"
    return _row(
        "ORPHANED_FK", "'sales'", "'customer_id'", "'high'", "'red'",
        orphan_rows="count(*)", orphan_values="count(DISTINCT customer_id)",
        orphan_rate=f"count(*) / (SELECT count(customer_id) FROM ({VIEWS['sales'].sql}))",
    ) + f" FROM ({VIEWS['sales'].sql}) WHERE customer_id NOT IN ({parent}) HAVING count(*) > 0"


def _formula_sql() -> str:
    return _row(
        "FORMULA_DRIFT", "'intake'", "'line_total'", "'high'", "'yellow'",
        violations="count(*) FILTER (abs(line_total - quantity * price) > 0.005)",
        checked="count(line_total - quantity * price)",
    ) + f" FROM ({VIEWS['intake'].sql})"


TABLE_KEYS = {"intake": "intake_id", "passages": "passage_id", "customers": "id", "sales": "id"}
_KIND_COLUMNS = 'code, "table", "column", severity, fix_risk'


def _quality_sql() -> str:
    """All quality findings of the audited views, without evidence."""
    rules = [
        _over_profiles(_NULLS),
        _over_profiles(_MIXED),
        _over_profiles(_OWN_KEY),
        _over_profiles(_DUPLICATE_KEY),
        _formats_sql(AUDITED),
        _labels_sql(AUDITED),
        _negatives_sql(AUDITED),
        _outliers_sql(AUDITED),
        _duplicate_rows_sql(AUDITED, TABLE_KEYS),
        _formula_sql(),
    ]
    return " UNION ALL ".join(f"SELECT {_KIND_COLUMNS} FROM ({r})" for r in rules)


def quality(spark, sf_dir) -> DataFrame:
    tables, profile = profiled(spark, sf_dir)
    return settle(Q.quality_findings(tables, profile, formulas=FORMULAS))


# --- SQL of the enrichment rules -----------------------------------------------------


def _products_sql(view: str) -> str:
    v = VIEWS[view]
    numeric = [c for c, k in v.columns if k in ("bigint", "int", "double")]
    parts = [
        f"""SELECT '{c}' AS target, '{a}' AS "left", '{b}' AS "right", count({c} * {a} * {b}) AS checked FROM data
        HAVING count(*) FILTER (abs({c} - CAST({a} AS DOUBLE) * {b}) > 0.005) = 0 AND count({c} * {a} * {b}) > 0"""
        for a, b in combinations(numeric, 2)
        for c in numeric
        if c not in (a, b)
    ]
    return f"WITH data AS ({v.sql}) " + " UNION ALL ".join(parts)


def _copies_sql(view: str) -> str:
    v = VIEWS[view]
    parts = [
        f"""SELECT '{a}' AS kept, '{b}' AS copy, count(*) AS checked FROM data
        HAVING count(*) FILTER ({a} IS DISTINCT FROM {b}) = 0"""
        for (a, x), (b, y) in combinations(v.columns, 2)
        if x == y and "currency" not in (a, b)
    ]
    return f"WITH data AS ({v.sql}) " + " UNION ALL ".join(parts)


def _dependencies(view: str):
    """Every column against every other one."""

    def run(spark, sf_dir):
        df = VIEWS[view].build(spark, sf_dir)
        return E.dependencies(df, df.columns, df.columns)

    return run


def _dependencies_sql(view: str) -> str:
    names = [c for c, _ in VIEWS[view].columns]
    parts = [
        f"""SELECT '{a}' AS determinant, '{b}' AS dependent, count(DISTINCT {a}) AS "values" FROM data
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL
        HAVING count(DISTINCT {a}) = count(DISTINCT ({a}, {b})) AND count(*) > 0"""
        for a in names
        for b in names
        if a != b
    ]
    return f"WITH data AS ({VIEWS[view].sql}) " + " UNION ALL ".join(parts)


_BIG = E.Options(partition_rows=10_000, partition_values=100, partition_fill=10)
_PROFILE_RULES = """SELECT 'REDUNDANT_COLUMN' AS code, "table", "column", 'low' AS severity, 'red' AS fix_risk
      FROM profile WHERE null_count = 0 AND distinct_count = 1 AND row_count > 1
    UNION ALL SELECT 'MISSING_CONSTRAINT', "table", "column", 'low', 'red' FROM profile WHERE null_count = 0
    UNION ALL SELECT 'MISSING_CONSTRAINT', "table", "column", 'medium', 'red' FROM profile
      WHERE cardinality_ratio = 1.0 AND row_count > 1
    UNION ALL SELECT 'PARTITION_OPPORTUNITY', "table", "column", 'low', 'red' FROM profile
      WHERE row_count >= 10000 AND (inferred_type IN ('date', 'datetime')
        OR (distinct_count > 1 AND distinct_count <= 100 AND row_count / distinct_count >= 10))"""
_ENRICHED = ["invoice", "orders", "intake"]


def enrichment(spark, sf_dir) -> DataFrame:
    _, profile = profiled(spark, sf_dir, _ENRICHED)
    return E.profile_findings(profile, options=_BIG)


# --- SQL of redaction -------------------------------------------------------------------

# The kinds of entities in the order they are replaced, restated for the SQL side.
_ENTITY_SHAPES = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CREDIT_CARD", r"\b([0-9][ -]?){12,15}[0-9]\b"),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("IP_ADDRESS", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"),
    ("PHONE_NUMBER", r"\+?[0-9][0-9 ()-]{7,}[0-9]"),
    ("URL", r"https?://[^ ]+"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b"),
)


def _redacted_sql(column: str) -> str:
    for entity, shape in _ENTITY_SHAPES:
        column = f"regexp_replace({column}, '{shape}', '[REDACTED:{entity}]', 'g')"
    return column


def _entities_sql(source: str, column: str) -> str:
    parts, left = [], column
    for entity, shape in _ENTITY_SHAPES:
        hits = f"len(regexp_extract_all({left}, '{shape}'))"
        parts.append(
            f"""SELECT '{column}' AS "column", '{entity}' AS entity, CAST(sum({hits}) AS BIGINT) AS hits,
            count(*) FILTER ({hits} > 0) AS rows FROM {source}"""
        )
        left = f"regexp_replace({left}, '{shape}', '[REDACTED:{entity}]', 'g')"
    return " UNION ALL ".join(parts)


# --- fixes ------------------------------------------------------------------------------

FIXES = [
    FX.Fix("intake", "quantity", "quantity < 0", "abs(quantity)"),
    FX.Fix("intake", "priority", "priority <> trim(priority)", "trim(priority)"),
    FX.Fix("intake", "email", "email LIKE '%/_at/_%' ESCAPE '/'", "replace(email, '_at_', '@')"),
    FX.Fix("intake", "line_total", "abs(line_total - quantity * price) > 0.005", "quantity * price"),
    FX.Fix("intake", "channel", "channel IS NULL", "'none'"),
    FX.Fix("intake", "missing", "missing > 1", "0"),
    FX.Fix("intake", "amount", "amount > 5000000", action="drop_rows"),
    FX.Fix("intake", "phone", "phone IS NULL", "'n/a'", risk="yellow"),
    FX.Fix("intake", "note", "no_such_function(note)", "'x'", risk="yellow"),
]
_FIXED = """SELECT intake_id, customer_id, placed, replace(email, '_at_', '@') AS email, trim(priority) AS priority,
    amount, abs(quantity) AS quantity, price,
    CASE WHEN abs(line_total - abs(quantity) * price) > 0.005 THEN abs(quantity) * price ELSE line_total END
      AS line_total,
    code, note, phone, coalesce(channel, 'none') AS channel, reviewer, agent
    FROM ({intake}) WHERE NOT amount > 5000000"""


def _dry_runs(spark, sf_dir):
    tables = inputs(spark, sf_dir, ["intake"])
    return FX.outcomes_frame(spark, FX.dry_run(tables, FIXES)).drop("error", "table")


def _dry_runs_sql() -> str:
    parts = []
    for i, f in enumerate(FIXES):
        bad = f.column == "missing" or "no_such" in f.predicate
        hits = "CAST(max(NULL) AS BIGINT)" if bad else f"count(*) FILTER ({f.predicate})"
        parts.append(
            f"""SELECT {i} AS seq, '{f.column}' AS "column", {str(not bad).lower()} AS passed,
            {hits} AS estimated_rows_affected, '{'drop' if bad else 'keep'}' AS disposition
            FROM ({VIEWS['intake'].sql})"""
        )
    return " UNION ALL ".join(parts)


def _cleaned(spark, sf_dir):
    tables = inputs(spark, sf_dir, ["intake"])
    return FX.apply_fixes(tables["intake"], "intake", FIXES, FX.dry_run(tables, FIXES))


def _failing(spark, sf_dir):
    """Findings on columns of the intake whose fixes fail, or do not, and what becomes of them."""
    tables = inputs(spark, sf_dir, ["intake"])

    def on(column, risk, predicate, value, kind=FD.QUALITY):
        fix = FD.set_value(F.col("column"), predicate, value)
        made = FD.finding("TRIED", "low", risk, f"{kind} {risk} {column}", {}, fix=fix, kind=kind)
        return F.when(F.col("column") == column, made)

    columns = describe_tables(tables)
    found = FD.emit(
        columns,
        on("quantity", "green", "quantity < 0", "'many'"),  # no whole number
        on("email", "yellow", "no_such_function(email)", "'x'"),
        on("price", "green", "price < 0", "0"),
        on("amount", "green", "amount > 1", "'dear'", FD.ENRICHMENT),
        on("agent", "yellow", "agent IS NULL", "'A0'", FD.ENRICHMENT),
        on("note", "red", "note IS NULL", "'x'"),
        on("channel", "green", "channel IS NULL", "raise_error('no')"),
    )
    done = FX.validate(tables, settle(found))[0]
    return done.select(
        "kind", "column", "fix_risk", F.col("fix").isNotNull().alias("has_fix"), "dry_run.passed",
        "dry_run.estimated_rows_affected", "dry_run.disposition",
    )


_FAILING_SQL = f"""SELECT kind, v."column", CASE WHEN risk = 'green' AND kind = 'quality' AND NOT passed THEN 'yellow' ELSE risk END AS fix_risk,
    coalesce(passed, false) AS has_fix, passed, CASE WHEN passed THEN hits END AS estimated_rows_affected,
    CASE WHEN passed THEN 'keep' WHEN NOT passed THEN 'drop' END AS disposition
    FROM (SELECT 'quality' AS kind, 'quantity' AS "column", 'green' AS risk, count(*) FILTER (quantity < 0) = 0 AS passed, count(*) FILTER (quantity < 0) AS hits FROM data
        UNION ALL SELECT 'quality', 'email', 'yellow', false, 0 FROM (SELECT 1)
        UNION ALL SELECT 'quality', 'price', 'green', true, count(*) FILTER (price < 0) FROM data
        UNION ALL SELECT 'enrichment', 'amount', 'green', count(*) FILTER (amount > 1) = 0, 0 FROM data
        UNION ALL SELECT 'enrichment', 'agent', 'yellow', true, count(*) FILTER (agent IS NULL) FROM data
        UNION ALL SELECT 'quality', 'note', 'red', NULL, 0 FROM (SELECT 1)
        UNION ALL SELECT 'quality', 'channel', 'green', count(*) FILTER (channel IS NULL) = 0, 0 FROM data) v"""
_FAILING_SQL = f"WITH data AS ({VIEWS['intake'].sql}) {_FAILING_SQL}"


def _disposed(spark, sf_dir):
    tables, profile = profiled(spark, sf_dir)
    found = settle(Q.quality_findings(tables, profile, formulas=FORMULAS))
    return settle(FX.validate(tables, found)[0])


# --- registration ---------------------------------------------------------------------------


def _rule(rule, *evidence, names=AUDITED):
    """A rule over the profile of some views."""
    return lambda s, d: flat(rule(profiled(s, d, names)[1]), *evidence)


def _scan(rule, *evidence, names=AUDITED):
    """A rule over one scan of some views."""
    return lambda s, d: flat(rule(Q.value_scan(inputs(s, d, names))), *evidence)


_SEVERITY_RANK = "list_position(['critical','high','medium','low'], severity)"


def register() -> dict[str, tuple]:
    q: dict[str, tuple] = {}

    # rules
    q["quality_null_share"] = (
        _rule(Q.null_findings, "null_pct", "null_count", "row_count"),
        _over_profiles(_NULLS),
    )
    q["quality_mixed_types"] = (
        lambda s, d: flat(
            Q.type_findings(profiled(s, d)[1]).where("code = 'MIXED_TYPES'"), "distinct_count"
        ),
        _over_profiles(_MIXED),
    )

    def mismatch(s, d):
        tables = inputs(s, d, ["order_sheet"])
        expected = {"order_sheet": {"id": "float", "total": "VARCHAR", "status": "VARCHAR", "placed": "string"}}
        return flat(Q.type_findings(profile_tables(tables, expected_types=expected)), "distinct_count")

    ctes = S.profile_ctes(
        "order_sheet", expected={"id": "float", "total": "VARCHAR", "status": "VARCHAR", "placed": "string"}
    )
    q["quality_type_mismatch"] = (mismatch, S.with_ctes(ctes, f"{_MISMATCH} UNION ALL {_MIXED}"))
    q["quality_own_key"] = (
        _rule(Q.own_key_findings, "cardinality_ratio", "distinct_count"),
        _over_profiles(_OWN_KEY),
    )
    q["quality_duplicate_key"] = (
        _rule(Q.duplicate_key_findings, "duplicate_rows", "row_count"),
        _over_profiles(_DUPLICATE_KEY),
    )
    q["quality_composite_key"] = (
        lambda s, d: Q.duplicate_keys(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
        """SELECT count(*) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM
           (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1""",
    )
    q["quality_formats"] = (_scan(Q.format_findings, "date_styles", "malformed"), _formats_sql(AUDITED))
    q["quality_label_variants"] = (
        lambda s, d: (
            lambda tables, profile: flat(
                Q.label_findings(tables, Q.label_columns(profile)), "labels", "spellings", "rows"
            )
        )(*profiled(s, d)),
        _labels_sql(AUDITED),
    )
    q["quality_negative_values"] = (
        _scan(Q.negative_findings, "negative_share", "negatives"),
        _negatives_sql(AUDITED),
    )
    q["quality_negative_values_wide_share"] = (
        _scan(
            lambda scan: Q.negative_findings(scan, Q.Thresholds(negative_share=0.5)),
            "negative_share", "negatives", names=["customer", "supplier"],
        ),
        _negatives_sql(["customer", "supplier"], share=0.5),
    )
    q["quality_outliers"] = (
        lambda s, d: flat(Q.outlier_findings(inputs(s, d, AUDITED)), "outliers", "p95"),
        _outliers_sql(AUDITED),
    )
    q["quality_outlier_statistics"] = (
        lambda s, d: Q.outlier_statistics(
            inputs(s, d, ["events", "lineitem", "intake"]), Q.Thresholds(outlier_ratio=2.0)
        ).select(
            "table", "column", "n", F.round("mean", 4).alias("mean"), F.round("sd", 2).alias("sd"), "p95", "outliers"
        ),
        _outliers_sql(
            ["events", "lineitem", "intake"], ratio=2.0,
            body='SELECT t AS "table", c AS "column", n, round(mean, 4) AS mean, round(sd, 2) AS sd, p95, outliers '
            "FROM hits",
        ),
    )
    q["quality_duplicate_rows"] = (
        lambda s, d: flat(
            Q.duplicate_row_findings(inputs(s, d, AUDITED), {t: [k] for t, k in TABLE_KEYS.items()}),
            "duplicate_groups", "duplicate_rows",
        ),
        _duplicate_rows_sql(AUDITED, TABLE_KEYS),
    )

    def orphaned(s, d):
        tables = inputs(s, d, ["sales", "customers"])
        tables["customers"] = tables["customers"].where("id >= 100")
        relation = dict(zip(("from_table", "from_column", "to_table", "to_column"), KEYS[0][1:]))
        return flat(Q.orphan_findings(tables, [relation]), "orphan_rows", "orphan_values", "orphan_rate")

    q["quality_orphans"] = (orphaned, _orphans_sql())
    q["quality_formula_drift"] = (
        lambda s, d: flat(
            Q.formula_findings(inputs(s, d, ["intake"]), FORMULAS), "violations", "checked"
        ),
        _formula_sql(),
    )
    q["quality_all_findings"] = (lambda s, d: flat(quality(s, d)), _quality_sql())

    # enrichment
    q["enrichment_derivable_columns"] = (
        lambda s, d: E.derivable_columns(VIEWS["invoice"].build(s, d)),
        _products_sql("invoice"),
    )
    q["enrichment_redundant_columns"] = (
        lambda s, d: E.redundant_pairs(VIEWS["invoice"].build(s, d), ["currency"]),
        _copies_sql("invoice"),
    )
    q["enrichment_dependencies"] = (
        _dependencies("invoice"),
        _dependencies_sql("invoice"),
    )
    # gaps: columns that are missing together or apart
    q["enrichment_dependencies_with_gaps"] = (_dependencies("intake"), _dependencies_sql("intake"))
    q["enrichment_derivable_with_gaps"] = (
        lambda s, d: E.derivable_columns(VIEWS["late_figures"].build(s, d)),
        _products_sql("late_figures"),
    )
    q["enrichment_profile_rules"] = (
        lambda s, d: flat(enrichment(s, d)),
        _over_profiles(_PROFILE_RULES, _ENRICHED),
    )
    q["enrichment_best"] = (
        lambda s, d: flat(E.best(enrichment(s, d))),
        _over_profiles(
            f'SELECT * FROM ({_PROFILE_RULES}) ORDER BY {_SEVERITY_RANK}, code, "table", "column" LIMIT 5', _ENRICHED
        ),
    )

    # redaction: all kinds of entities over whole tables
    q["redacted_documents"] = (
        lambda s, d: redaction.redact_columns(load(s, d, "documents"), ["text"]),
        f"SELECT doc_id, {_redacted_sql('text')} AS text, lang, source, n_chars FROM documents",
    )
    q["redacted_conversations"] = (
        lambda s, d: redaction.redact_columns(load(s, d, "conversations"), ["text"]),
        f"SELECT conv_id, turn, role, {_redacted_sql('text')} AS text FROM conversations",
    )
    q["entity_report"] = (
        lambda s, d: redaction.entity_report(load(s, d, "documents"), ["text"]),
        _entities_sql("documents", "text"),
    )
    q["redacted_page_addresses"] = (
        lambda s, d: redaction.redact_columns(load(s, d, "pages"), ["url", "html"]),
        f"SELECT page_id, {_redacted_sql('url')} AS url, {_redacted_sql('html')} AS html FROM pages",
    )
    # kinds that the texts do not hold
    q["redacted_contacts"] = (
        lambda s, d: redaction.redact_columns(VIEWS["contacts"].build(s, d), ["line"]),
        f"SELECT id, {_redacted_sql('line')} AS line FROM ({VIEWS['contacts'].sql})",
    )
    q["entity_report_contacts"] = (
        lambda s, d: redaction.entity_report(VIEWS["contacts"].build(s, d), ["line"]),
        _entities_sql(f"({VIEWS['contacts'].sql})", "line"),
    )

    def redacted_profile(s, d):
        profile = redaction.redact_profile(profile_tables(inputs(s, d, ["conversations", "intake", "contacts"])))
        return top_values(profile)

    q["redacted_top_values"] = (
        redacted_profile,
        S.profiles_sql(["conversations", "intake", "contacts"], S.TOP_BODY.replace("r.value,", f"{_redacted_sql('r.value')} AS value,")),
    )

    # fixes
    q["fix_dry_runs"] = (_dry_runs, _dry_runs_sql())
    q["fix_applied"] = (_cleaned, _FIXED.format(intake=VIEWS["intake"].sql))
    q["fix_investigation"] = (
        lambda s, d: FX.investigate(VIEWS["intake"].build(s, d), "quantity < 0", ["intake_id", "customer_id"]),
        f"SELECT * FROM ({VIEWS['intake'].sql}) WHERE quantity < 0 ORDER BY intake_id, customer_id LIMIT 100",
    )
    q["fix_red_gate"] = (
        lambda s, d: quality(s, d).groupBy("fix_risk").agg(
            F.count_if(F.col("fix").isNotNull()).alias("with_fix"), F.count(F.lit(1)).alias("findings")
        ),
        f"""SELECT fix_risk, count(*) FILTER (fix_risk <> 'red') AS with_fix, count(*) AS findings
            FROM ({_quality_sql()}) GROUP BY fix_risk""",
    )
    q["fix_dispositions"] = (
        lambda s, d: _disposed(s, d).select(
            "code", F.array_join("tables", ",").alias("table"), "column", "fix_risk", "dry_run.passed",
            "dry_run.disposition",
        ),
        f"""SELECT code, "table", "column", fix_risk, CASE WHEN fix_risk <> 'red' THEN true END AS passed,
            CASE WHEN fix_risk <> 'red' THEN 'keep' END AS disposition FROM ({_quality_sql()})""",
    )

    # reports
    both = f"""SELECT 'quality' AS kind, {_KIND_COLUMNS} FROM ({_quality_sql()}) UNION ALL
        SELECT 'enrichment', {_KIND_COLUMNS} FROM ({_over_profiles(_PROFILE_RULES, _ENRICHED)})"""

    def all_findings(s, d):
        return RP.combined(quality(s, d), enrichment(s, d))

    q["report_findings_combined"] = (lambda s, d: flat(all_findings(s, d)), f"SELECT {_KIND_COLUMNS} FROM ({both})")
    q["report_severity_counts"] = (
        lambda s, d: RP.severity_counts(all_findings(s, d)),
        f"""SELECT s.severity, count(f.code) AS findings FROM
            (VALUES ('critical'), ('high'), ('medium'), ('low')) AS s(severity)
            LEFT JOIN ({both}) f ON f.severity = s.severity GROUP BY s.severity""",
    )
    score = """CAST(greatest(0, 100 - 15 * count(*) FILTER (kind = 'quality' AND severity = 'critical')
        - 8 * count(*) FILTER (kind = 'quality' AND severity = 'high')
        - 3 * count(*) FILTER (kind = 'quality' AND severity = 'medium')
        - count(*) FILTER (kind = 'quality' AND severity = 'low')
        - least(count(*) FILTER (kind = 'enrichment'), 5)) AS INTEGER)"""
    summary_sql = f"""SELECT health_score, CASE WHEN health_score >= 80 THEN 'Good' WHEN health_score >= 50
        THEN 'Fair' ELSE 'Poor' END AS band, critical_count, high_count, medium_count, low_count,
        'Quality findings: ' || q || ' (critical ' || qc || ', high ' || qh || '). Enrichment findings: ' || e || '.' AS summary
        FROM (SELECT {score} AS health_score,
            count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
            count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (severity = 'low') AS low_count,
            count(*) FILTER (kind = 'quality') AS q, count(*) FILTER (kind = 'enrichment') AS e,
            count(*) FILTER (kind = 'quality' AND severity = 'critical') AS qc,
            count(*) FILTER (kind = 'quality' AND severity = 'high') AS qh FROM (%s))"""
    q["report_summary"] = (lambda s, d: RP.summary(all_findings(s, d)), summary_sql % both)

    def one_table(s, d):
        tables, profile = profiled(s, d, ["passages"])
        return RP.summary(Q.quality_findings(tables, profile))

    q["report_summary_one_table"] = (
        one_table,
        summary_sql
        % f"""SELECT 'quality' AS kind, severity, code FROM ({_quality_sql()}) WHERE "table" = 'passages'""",
    )
    # what ties on the ordering columns is alike in all that is compared
    reading = '"table", "column" NULLS FIRST, code'
    q["report_findings_numbered"] = (
        lambda s, d: RP.findings_table(all_findings(s, d)).drop("description", "evidence"),
        f"""SELECT *, row_number() OVER (PARTITION BY kind, severity ORDER BY {reading}) AS number FROM ({both})""",
    )
    phase = """CASE WHEN fix_risk = 'green' THEN 1 WHEN fix_risk = 'yellow' THEN 2
        WHEN kind = 'quality' THEN 3 END"""
    q["report_runbook"] = (
        lambda s, d: RP.runbook(all_findings(s, d)).select(
            "phase", "step", "kind", "code", "table", "column", F.col("fix").isNotNull().alias("has_fix")
        ),
        f"""SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY kind DESC, {reading}) AS step, kind, code,
            "table", "column", phase < 3 AS has_fix FROM (SELECT *, {phase} AS phase FROM ({both})) WHERE phase IS NOT NULL""",
    )
    q["fix_selection"] = (
        lambda s, d: RP.selected_fixes(all_findings(s, d), "yellow").select("kind", "code", F.array_join("tables", ",").alias("table"), "column"),
        f"""SELECT kind, code, "table", "column" FROM ({both}) WHERE fix_risk = 'yellow'""",
    )

    def whole_audit(s, d):
        tables = inputs(s, d, AUDITED)
        return audit(tables, formulas=FORMULAS, enrich=False, keys={t: [k] for t, k in TABLE_KEYS.items()})

    of_quality = f"SELECT 'quality' AS kind, {_KIND_COLUMNS} FROM ({_quality_sql()})"
    q["audit_findings"] = (
        lambda s, d: whole_audit(s, d).findings.select(
            "kind", "code", F.array_join("tables", ",").alias("table"), "column", "severity", "fix_risk"
        ),
        of_quality,
    )
    q["audit_summary"] = (lambda s, d: whole_audit(s, d).summary, summary_sql % of_quality)
    clean = ["nations", "region_list"]

    def of_clean(s, d):
        tables, profile = profiled(s, d, clean)
        return Q.quality_findings(tables, profile, keys={t: ["id"] for t in clean}).agg(F.count("*").alias("findings"))

    q["quality_clean_tables"] = (
        of_clean,
        "SELECT count(*) AS findings FROM (" + " UNION ALL ".join(
            f"SELECT code FROM ({x})" for x in (
                _over_profiles(_NULLS, clean), _over_profiles(_MIXED, clean), _over_profiles(_OWN_KEY, clean),
                _over_profiles(_DUPLICATE_KEY, clean), _formats_sql(clean), _labels_sql(clean), _negatives_sql(clean),
                _outliers_sql(clean), _duplicate_rows_sql(clean, dict.fromkeys(clean, "id")),
            )
        ) + ")",
    )
    q["report_generated_at"] = (
        lambda s, d: load(s, d, "orders").select("o_orderkey", RP.generated_at(F.col("o_orderdate")).alias("shown")),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS shown FROM orders",
    )
    q["report_documents"] = (
        lambda s, d: RP.as_json(load(s, d, "customer")),
        "SELECT CAST(to_json(customer) AS VARCHAR) AS document FROM customer",
    )
    type_names = """CASE o_custkey % 6 WHEN 0 THEN concat('decimal(', o_custkey % 30 + 1, ', 2)') WHEN 1 THEN concat('VARCHAR(', o_custkey, ')')
        WHEN 2 THEN 'BIGINT' WHEN 3 THEN 'timestamp with time zone' WHEN 4 THEN 'tinyint' ELSE concat('Double ', '(', o_custkey, ')') END"""
    q["catalog_labels"] = (
        lambda s, d: load(s, d, "orders").select(F.expr(type_names).alias("type")).select("type", catalog_label(F.col("type")).alias("label")),
        f"""SELECT type, CASE WHEN bare = 'BIGINT' THEN 'integer' WHEN bare IN ('DECIMAL', 'DOUBLE') THEN 'float'
            WHEN bare LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END AS label
            FROM (SELECT *, upper(trim(split_part(type, '(', 1))) AS bare FROM (SELECT {type_names} AS type FROM orders))""",
    )

    def sheet_lines(s, d):
        rows = load(s, d, "customer").selectExpr(
            "c_custkey + 1 AS number",
            "CASE c_custkey % 3 WHEN 0 THEN concat(c_custkey, ',', c_name) "
            "WHEN 1 THEN concat(c_custkey, ',\"', c_name, ', \"\"Inc\"\"\",', c_nationkey) "
            "ELSE concat(c_custkey, ',,', c_nationkey, ',', c_mktsegment, ',more') END AS line",
        )
        head = rows.orderBy("number").limit(1).selectExpr("0L AS number", "' key ,Name,,name' AS line")
        return files.sheet(s, head.union(rows))

    q["sheet_rows"] = (
        sheet_lines,
        """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || ', "Inc"' END AS "Name",
            CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS col_2,
            CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS name_1, CASE WHEN c_custkey % 3 = 2 THEN 'more' END AS col_4 FROM customer""",
    )
    q["sheet_as_text"] = (
        lambda s, d: files.as_text(load(s, d, "customer").toDF(" key", "Key ", "", "c", "C_1")),
        """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS "Key_1", CAST(c_nationkey AS VARCHAR) AS col_2,
            CAST(c_acctbal AS VARCHAR) AS c, c_mktsegment AS "C_1" FROM customer""",
    )
    q["profile_rounded"] = (
        lambda s, d: rounded(profile_tables(inputs(s, d, ["labelled"]))).select("column", "null_pct", "cardinality_ratio"),
        S.with_ctes(
            S.profile_ctes("labelled"),
            'SELECT "column", round(null_pct, 4) AS null_pct, round(cardinality_ratio, 4) AS cardinality_ratio FROM profile',
        ),
    )

    # rows behind findings over groups
    intake, passages = VIEWS["intake"].sql, VIEWS["passages"].sql

    def behind(code, table, column):
        def run(s, d):
            tables = inputs(s, d, AUDITED)
            found = quality(s, d).where((F.col("code") == code) & F.col("column").eqNullSafe(F.lit(column)) & (F.col("tables")[0] == table))
            return offending_rows(tables, found.first(), {t: [k] for t, k in TABLE_KEYS.items()})

        return run

    q["fix_investigation_repeated_keys"] = (
        behind("POSSIBLE_DUPLICATE", "intake", "intake_id"),
        f"SELECT * FROM ({intake}) WHERE intake_id IN (SELECT intake_id FROM ({intake}) GROUP BY intake_id HAVING count(*) > 1)",
    )
    q["fix_investigation_repeated_rows"] = (
        behind("POSSIBLE_DUPLICATE", "passages", None),
        f"""SELECT p.* FROM ({passages}) p JOIN (SELECT text, lang, source, n_chars FROM ({passages})
            GROUP BY ALL HAVING count(*) > 1) USING (text, lang, source, n_chars)""",
    )
    q["fix_investigation_own_key"] = (
        behind("CARDINALITY_ANOMALY", "intake", "intake_id"),
        f"SELECT * FROM ({intake}) WHERE intake_id IN (SELECT intake_id FROM ({intake}) GROUP BY intake_id HAVING count(*) > 1)",
    )

    # fixes that fail their dry run, of both kinds
    q["fix_failing_dispositions"] = (_failing, _FAILING_SQL)
    q["report_scope"] = (
        lambda s, d: RP.scope(all_findings(s, d), "parquet"),
        f"""SELECT 'PARQUET' AS source_type, string_agg(t, ', ' ORDER BY t) AS tables FROM
            (SELECT DISTINCT "table" AS t FROM ({both}))""",
    )
    q["report_scope_tables"] = (
        lambda s, d: RP.scope_tables(all_findings(s, d)),
        f'SELECT DISTINCT "table" FROM ({both})',
    )

    def history(s, d):
        reports = load(s, d, "orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS job_id", "CAST(o_totalprice / 5000 AS INT) AS health_score",
            "o_orderdate AS created_at",
        )
        jobs = load(s, d, "customer").selectExpr(
            "c_custkey AS id", "c_mktsegment AS user_id", "c_nationkey AS source_id"
        )
        sources = load(s, d, "nation").selectExpr(
            "n_nationkey AS id", "n_name AS name", "'postgres' AS source_type"
        )
        return RP.report_history(reports, jobs, sources, "BUILDING", 50)

    q["report_history"] = (
        history,
        """SELECT o_orderkey AS id, o_custkey AS job_id, CAST(trunc(o_totalprice / 5000) AS INTEGER) AS health_score,
                  n_name AS source_name, 'postgres' AS source_type, o_orderdate AS created_at
           FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
           WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
    )
    q["report_latest_jobs"] = (
        lambda s, d: RP.latest(
            load(s, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_orderdate AS created_at"),
            limit=500,
        ),
        """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at FROM orders
           ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""",
    )
    return q
