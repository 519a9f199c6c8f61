"""SQL for column profiles, written per column as a reader would by hand."""

from __future__ import annotations

from contract.views import VIEWS

# Shapes, restated for the SQL side.
ISO_DATE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"
)
WHOLE = r"^-?[0-9]{1,20}\z"
REAL = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
LENIENT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
PLAIN = r"^-?[0-9]+(\.[0-9]*)?\z"
WORDS = "('0','1','true','false','yes','no','t','f','y','n')"


def number(column: str, kind: str, rule: str = "lenient") -> str:
    if kind in ("timestamp", "date") or (kind == "boolean" and rule == "plain"):
        return "CAST(NULL AS DOUBLE)"
    if kind == "string":
        gate = LENIENT if rule == "lenient" else PLAIN
        return f"CASE WHEN regexp_matches({column}, '{gate}') THEN TRY_CAST({column} AS DOUBLE) END"
    return f"CAST({column} AS DOUBLE)"


def profile_ctes(
    view: str,
    tag: str = "",
    rule: str = "lenient",
    deviation: str = "stddev_samp",
    base: str = "non_null",
    expected: dict[str, str] | None = None,
) -> list[str]:
    """CTEs ending in ``profile{tag}`` (one row per column) and ``ranked{tag}``."""
    v = VIEWS[view]
    expected = expected or {}
    stats, freq = [], []
    for i, (c, kind) in enumerate(v.columns):
        n = number(c, kind, rule)
        declared = expected.get(c, v.label(c))
        stats.append(
            f"""SELECT '{view}' AS "table", '{c}' AS "column", {i} AS ordinal, '{declared}' AS declared_type,
                       count(*) AS row_count, count(*) - count({c}) AS null_count,
                       count(DISTINCT {c}) AS distinct_count,
                       min(CAST({c} AS VARCHAR)) AS min_val, max(CAST({c} AS VARCHAR)) AS max_val,
                       avg({n}) AS mean_val, {deviation}({n}) AS std_val
                FROM data{tag}"""
        )
        freq.append(
            f"""SELECT {i} AS ordinal, CAST({c} AS VARCHAR) AS value, count(*) AS cnt,
                       row_number() OVER (ORDER BY count(*) DESC, {c}) AS rnk
                FROM data{tag} WHERE {c} IS NOT NULL GROUP BY {c}"""
        )
    share_base = "row_count - null_count" if base == "non_null" else "row_count"
    return [
        f"data{tag} AS ({v.sql})",
        f"stats{tag} AS ({' UNION ALL '.join(stats)})",
        f"ranked{tag} AS (SELECT * FROM ({' UNION ALL '.join(freq)}) WHERE rnk <= 20)",
        f"""shapes{tag} AS (
            SELECT ordinal, bool_and(regexp_matches(value, '{ISO_DATE}')) AS dates,
                   bool_and(regexp_matches(value, '{WHOLE}')) AS wholes,
                   bool_and(regexp_matches(value, '{REAL}')) AS reals,
                   bool_and(lower(value) IN {WORDS}) AS words,
                   count(*) AS listed,
                   count(*) FILTER (regexp_matches(value, '{WHOLE}') OR regexp_matches(value, '{REAL}')) AS numbers
            FROM ranked{tag} GROUP BY ordinal)""",
        f"""typed{tag} AS (
            SELECT s.*, coalesce(h.words, false) AS words, coalesce(h.listed, 0) AS listed,
                   coalesce(h.numbers, 0) AS numbers,
                   CASE WHEN s.declared_type NOT IN ('string', 'VARCHAR') THEN s.declared_type
                        WHEN h.dates THEN 'date' WHEN h.wholes THEN 'integer'
                        WHEN h.reals THEN 'float' WHEN h.words THEN 'boolean' ELSE 'string' END AS inferred_type,
                   CASE WHEN row_count > 0 THEN null_count / row_count ELSE 0.0 END AS null_pct,
                   CASE WHEN row_count > null_count THEN distinct_count / (row_count - null_count)
                        ELSE 0.0 END AS cardinality_ratio,
                   {share_base} AS share_base
            FROM stats{tag} s LEFT JOIN shapes{tag} h USING (ordinal))""",
        f"""profile{tag} AS (
            SELECT *, concat_ws(',',
                CASE WHEN row_count > 0 AND null_count = row_count THEN 'all_null'
                     WHEN null_pct >= 0.5 THEN 'high_null_critical'
                     WHEN null_pct >= 0.2 THEN 'high_null' END,
                CASE WHEN cardinality_ratio <= 0.05 AND distinct_count > 1 THEN 'possible_enum' END,
                CASE WHEN distinct_count <= 3 AND listed > 0 AND words THEN 'possible_boolean' END,
                CASE WHEN cardinality_ratio >= 0.98 AND distinct_count > 10 THEN 'near_unique' END,
                CASE WHEN declared_type <> inferred_type AND declared_type <> 'string' THEN 'type_mismatch' END,
                CASE WHEN declared_type = 'string' AND numbers > 0 AND numbers < listed THEN 'mixed_types' END
            ) AS flags FROM typed{tag})""",
    ]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


PROFILE_BODY = """SELECT "table", "column", ordinal, declared_type, inferred_type, row_count, null_count, null_pct,
       distinct_count, cardinality_ratio, min_val, max_val, round(mean_val, 4) AS mean_val,
       round(std_val, 4) AS std_val, flags AS pattern_flags FROM profile{tag}"""


def profile_sql(view: str, **options) -> str:
    return with_ctes(profile_ctes(view, **options), PROFILE_BODY.replace("{tag}", ""))


def profiles_sql(views: list[str], body: str = PROFILE_BODY) -> str:
    """The same body over several views, stacked."""
    ctes, parts = [], []
    for n, view in enumerate(views):
        ctes += profile_ctes(view, tag=f"_{n}")
        parts.append(body.replace("{tag}", f"_{n}"))
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


def all_profiles_cte(views: list[str]) -> list[str]:
    """CTEs ending in ``profile`` and ``ranked`` over several views."""
    ctes, profiles, ranked = [], [], []
    for n, view in enumerate(views):
        ctes += profile_ctes(view, tag=f"_{n}")
        profiles.append(f"SELECT * FROM profile_{n}")
        ranked.append(f"SELECT '{view}' AS \"table\", * FROM ranked_{n}")
    return [
        *ctes,
        f"profile AS ({' UNION ALL '.join(profiles)})",
        f"ranked AS ({' UNION ALL '.join(ranked)})",
    ]


TOP_BODY = """SELECT p."table", p."column", r.rnk AS rank, r.value, r.cnt AS count,
       r.cnt * 100.0 / p.share_base AS pct
FROM ranked{tag} r JOIN profile{tag} p ON p.ordinal = r.ordinal"""


def top_sql(view: str, **options) -> str:
    return with_ctes(profile_ctes(view, **options), TOP_BODY.replace("{tag}", ""))
