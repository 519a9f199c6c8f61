"""Registered queries: relationships and declared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import profile_sql as S
from contract.profiling import inputs
from contract.views import VIEWS, load
from plumbline import profile_tables
from plumbline.operators import orphans, relations as R
from plumbline.sources import catalog
from plumbline.sources.settle import settle

STAR = ["customers", "sales", "nations", "region_list", "suppliers", "sale_lines"]

# The keys a catalog would declare for the star views.
KEYS = [
    ("fk_sales_customers", "sales", "customer_id", "customers", "id"),
    ("fk_customers_nations", "customers", "nation_id", "nations", "id"),
]
_SORTED = sorted(VIEWS)


def star_profile(spark, sf_dir) -> DataFrame:
    return settle(profile_tables(inputs(spark, sf_dir, STAR)))


def flat(relations: DataFrame) -> DataFrame:
    return relations.withColumn("evidence", F.array_join("evidence", ","))


def ansi_catalog(spark):
    """The three ANSI catalog tables declaring KEYS, plus one non-key constraint."""
    constraints = spark.createDataFrame(
        [(k[0], "public", k[1], "FOREIGN KEY") for k in KEYS] + [("pk_sales", "public", "sales", "PRIMARY KEY")],
        "constraint_name string, table_schema string, table_name string, constraint_type string",
    )
    usage = "constraint_name string, table_schema string, table_name string, column_name string"
    key_columns = spark.createDataFrame(
        [(k[0], "public", k[1], k[2]) for k in KEYS] + [("pk_sales", "public", "sales", "id")], usage
    )
    targets = spark.createDataFrame([(k[0], "public", k[3], k[4]) for k in KEYS], usage)
    return constraints, key_columns, targets


def mysql_catalog(spark):
    key_columns = spark.createDataFrame(
        [(k[0], "shop", k[1], k[2], k[3], k[4]) for k in KEYS] + [("PRIMARY", "shop", "sales", "id", None, None)],
        "constraint_name string, table_schema string, table_name string, column_name string, "
        "referenced_table_name string, referenced_column_name string",
    )
    constraints = spark.createDataFrame(
        [(k[0], "shop", k[1], "FOREIGN KEY") for k in KEYS] + [("PRIMARY", "shop", "sales", "PRIMARY KEY")],
        "constraint_name string, table_schema string, table_name string, constraint_type string",
    )
    return key_columns, constraints


def mssql_catalog(spark):
    names = {n: i + 1 for i, n in enumerate(STAR)}
    numbers = {(v, c): j + 1 for v in STAR for j, (c, _) in enumerate(VIEWS[v].columns)}
    tables = spark.createDataFrame([(i, n) for n, i in names.items()], "object_id int, name string")
    columns = spark.createDataFrame(
        [(names[v], j, c) for (v, c), j in numbers.items()], "object_id int, column_id int, name string"
    )
    key_columns = spark.createDataFrame(
        [(names[a], numbers[a, b], names[c], numbers[c, d]) for _, a, b, c, d in KEYS],
        "parent_object_id int, parent_column_id int, referenced_object_id int, referenced_column_id int",
    )
    return key_columns, tables, columns


def _checked_keys(declared):
    """Declared keys with the rows of the referring column, from its profile."""

    def run(spark, sf_dir):
        keys = declared(spark)
        profile = star_profile(spark, sf_dir).select(
            F.col("table").alias("from_table"),
            F.col("column").alias("from_column"),
            (F.col("row_count") - F.col("null_count")).alias("referring_rows"),
            F.col("distinct_count").alias("referring_values"),
        )
        return keys.join(profile, ["from_table", "from_column"])

    parts = [
        f"""SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column,
            count({b}) AS referring_rows, count(DISTINCT {b}) AS referring_values FROM ({VIEWS[a].sql})"""
        for _, a, b, c, d in KEYS
    ]
    return run, " UNION ALL ".join(parts)


# SQL of the name rules, pairwise as stated: every column against every other table.
def _pairs_sql(singular: bool, columns: str) -> str:
    extra = " OR lower(k.\"column\") = regexp_replace(lower(k.\"table\"), 's$', '') || '_id'" if singular else ""
    return f"""
    keys AS (SELECT k."table" AS to_table, arg_min(k."column", k.ordinal) AS to_column,
                    arg_min(k.inferred_type, k.ordinal) AS to_type FROM profile k
             WHERE lower(k."column") = 'id' OR lower(k."column") = k."table" || '_id'{extra} GROUP BY 1),
    named AS (SELECT p."table" AS from_table, p."column" AS from_column, p.ordinal AS from_ordinal,
                     p.inferred_type AS from_type, k.*,
                     regexp_replace(lower(p."column"), '(_id|_key|_fk)$', '') AS stem
              FROM profile p CROSS JOIN keys k WHERE p."table" <> k.to_table),
    pairs AS (SELECT * FROM named WHERE stem = lower(to_table) OR lower(to_table) IN (stem || 's', stem || 'es')
              OR lower(from_column) IN (lower(to_table) || '_id', lower(to_table) || '_key')),
    texts AS (SELECT p."table", p."column", r.value FROM ranked r JOIN profile p
              ON p."table" = r."table" AND p.ordinal = r.ordinal),
    sizes AS (SELECT "table", "column", count(DISTINCT value) AS n FROM texts GROUP BY ALL),
    shared AS (SELECT from_table, from_column, to_table, count(*) AS n FROM pairs q
               JOIN texts a ON a."table" = from_table AND a."column" = from_column
               JOIN texts b ON b."table" = to_table AND b."column" = to_column AND a.value = b.value
               GROUP BY ALL),
    scored AS (SELECT q.*, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0.0
                        ELSE coalesce(s.n, 0) / least(a.n, b.n) END AS overlap,
                 from_type = to_type
                   OR (from_type IN ('integer','float','numeric','bigint','int')
                       AND to_type IN ('integer','float','numeric','bigint','int'))
                   OR (from_type IN ('string','varchar','text','char')
                       AND to_type IN ('string','varchar','text','char')) AS same_kind
                 FROM pairs q
                 LEFT JOIN sizes a ON a."table" = from_table AND a."column" = from_column
                 LEFT JOIN sizes b ON b."table" = to_table AND b."column" = to_column
                 LEFT JOIN shared s USING (from_table, from_column, to_table)),
    inferred AS (SELECT from_table, from_column, to_table, to_column,
                 CASE WHEN overlap >= 0.7 THEN 0.9 WHEN same_kind THEN 0.7 ELSE 0.5 END AS confidence,
                 concat_ws(',', 'name_match', CASE WHEN same_kind THEN 'type_compatible' END,
                     CASE WHEN overlap >= 0.7 THEN printf('value_overlap:%.2f', overlap) END) AS evidence,
                 false AS is_declared FROM scored)"""


def _relations_sql(body: str, singular: bool = False) -> str:
    ctes = S.all_profiles_cte(STAR) + [_pairs_sql(singular, "")]
    return S.with_ctes(ctes, body)


_DECLARED_ROWS = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for _, a, b, c, d in KEYS)
_WITH_DECLARED = f"""SELECT *, 1.0 AS confidence, 'declared_fk' AS evidence, true AS is_declared
    FROM (VALUES {_DECLARED_ROWS}) AS t(from_table, from_column, to_table, to_column)
    UNION ALL SELECT * FROM inferred WHERE (from_table, from_column, to_table, to_column) NOT IN (
        SELECT (from_table, from_column, to_table, to_column)
        FROM (VALUES {_DECLARED_ROWS}) AS t(from_table, from_column, to_table, to_column))"""


def _declared(spark):
    return catalog.declared_keys_ansi(*ansi_catalog(spark))


def _composite_keys(spark, sf_dir):
    """A key of one to three columns for each customer, from catalog tables stored for this: each refers
    to its segment's table by the columns of that table's primary key, in the opposite order."""
    customers = load(spark, sf_dir, "customer")
    own = customers.selectExpr("concat('fk_', c_custkey) AS constraint_name", "'public' AS table_schema",
                               "concat('branch_', c_nationkey) AS table_name", "'FOREIGN KEY' AS constraint_type")
    targets = customers.selectExpr("concat('pk_', c_mktsegment, '_', c_custkey % 3 + 1) AS constraint_name", "'public' AS table_schema",
                                   "concat(c_mktsegment, '_', c_custkey % 3 + 1) AS table_name", "'PRIMARY KEY' AS constraint_type", "c_custkey % 3 + 1 AS size")
    targets = targets.distinct()
    from_side = customers.selectExpr("*", "explode(sequence(1, CAST(c_custkey % 3 + 1 AS INT))) AS ordinal_position").selectExpr(
        "concat('fk_', c_custkey) AS constraint_name", "'public' AS table_schema", "concat('branch_', c_nationkey) AS table_name",
        "concat('c', c_custkey, '_', ordinal_position) AS column_name", "ordinal_position",
        "CAST(c_custkey % 3 + 2 - ordinal_position AS INT) AS position_in_unique_constraint",
    )
    to_side = targets.selectExpr("*", "explode(sequence(1, CAST(size AS INT))) AS ordinal_position").selectExpr(
        "constraint_name", "table_schema", "table_name", "concat('k', ordinal_position) AS column_name", "ordinal_position",
        "CAST(NULL AS INT) AS position_in_unique_constraint",
    )
    references = customers.selectExpr(
        "concat('fk_', c_custkey) AS constraint_name", "'public' AS constraint_schema",
        "concat('pk_', c_mktsegment, '_', c_custkey % 3 + 1) AS unique_constraint_name", "'public' AS unique_constraint_schema",
    )
    stored = [settle(df, bounded=False) for df in (own.union(targets.drop("size")), from_side.union(to_side), references)]
    return catalog.declared_keys_ansi(stored[0], stored[1], references=stored[2])


_COMPOSITE_SQL = """SELECT 'branch_' || c_nationkey AS from_table, 'c' || c_custkey || '_' || p AS from_column,
    c_mktsegment || '_' || (c_custkey % 3 + 1) AS to_table, 'k' || (c_custkey % 3 + 2 - p) AS to_column
    FROM (SELECT *, unnest(range(1, CAST(c_custkey % 3 + 2 AS BIGINT))) AS p FROM customer)"""


def register() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    q["relation_candidates"] = (
        lambda s, d: R.candidates(star_profile(s, d)).select(
            "from_table", "from_column", "to_table", "to_column", "from_type", "to_type"
        ),
        _relations_sql("SELECT from_table, from_column, to_table, to_column, from_type, to_type FROM pairs"),
    )
    q["relation_target_keys"] = (
        lambda s, d: R.target_keys(star_profile(s, d)).select("to_table", "to_column", "to_type"),
        _relations_sql("SELECT to_table, to_column, to_type FROM keys"),
    )
    q["relation_key_stems"] = (
        lambda s, d: star_profile(s, d).select("table", "column", R.X.key_stem(F.col("column")).alias("stem")),
        _relations_sql(
            "SELECT \"table\", \"column\", regexp_replace(lower(\"column\"), '(_id|_key|_fk)$', '') AS stem FROM profile"
        ),
    )
    q["relation_value_overlap"] = (
        lambda s, d: R.candidates(star_profile(s, d)).select(
            "from_table", "from_column", "to_table",
            R.overlap_ratio(F.col("from_values"), F.col("to_values")).alias("overlap"),
            R.compatible_types(F.col("from_type"), F.col("to_type")).alias("same_kind"),
        ),
        _relations_sql("SELECT from_table, from_column, to_table, overlap, same_kind FROM scored"),
    )
    q["relations_inferred"] = (
        lambda s, d: flat(R.infer_relations(star_profile(s, d))),
        _relations_sql("SELECT * FROM inferred"),
    )
    q["relations_singular_keys"] = (
        lambda s, d: flat(R.infer_relations(star_profile(s, d), singular_names=True)),
        _relations_sql("SELECT * FROM inferred", singular=True),
    )
    q["relations_with_declared"] = (
        lambda s, d: flat(R.infer_relations(star_profile(s, d), _declared(s))),
        _relations_sql(_WITH_DECLARED),
    )
    q["relationship_map"] = (
        lambda s, d: R.relationship_map(R.infer_relations(star_profile(s, d), _declared(s))),
        _relations_sql(
            f"""SELECT from_table, from_column, to_table, to_column, printf('%.2f', confidence) AS confidence,
            replace(evidence, ',', ', ') AS evidence, is_declared FROM ({_WITH_DECLARED})"""
        ),
    )
    q["declared_keys_ansi"] = _checked_keys(_declared)
    q["declared_keys_mysql"] = _checked_keys(lambda s: catalog.declared_keys_mysql(*mysql_catalog(s), "shop"))
    q["declared_keys_mssql"] = _checked_keys(lambda s: catalog.declared_keys_mssql(*mssql_catalog(s)))

    q["declared_keys_composite"] = (_composite_keys, _COMPOSITE_SQL)

    def orphaned(spark, sf_dir):
        sales = VIEWS["sales"].build(spark, sf_dir)
        customers = VIEWS["customers"].build(spark, sf_dir).where("id >= 100")
        return orphans.orphan_counts(sales, ["customer_id"], customers, ["id"])

    q["orphaned_keys"] = (
        orphaned,
        f"""SELECT count(customer_id) AS referring_rows,
            count(customer_id) FILTER (customer_id NOT IN (SELECT id FROM ({VIEWS['customers'].sql}) WHERE id >= 100))
              AS orphan_rows,
            count(DISTINCT customer_id) FILTER (customer_id NOT IN
              (SELECT id FROM ({VIEWS['customers'].sql}) WHERE id >= 100)) AS orphan_values
            FROM ({VIEWS['sales'].sql})""",
    )
    q["orphaned_rows"] = (
        lambda s, d: orphans.orphan_rows(
            VIEWS["sales"].build(s, d), ["customer_id"], VIEWS["customers"].build(s, d).where("id >= 100"), ["id"]
        ),
        f"""SELECT * FROM ({VIEWS['sales'].sql}) WHERE customer_id NOT IN
            (SELECT id FROM ({VIEWS['customers'].sql}) WHERE id >= 100)""",
    )
    return q
