"""Registered queries: sources and column profiles."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import profile_sql as S
from contract.views import TABLES, VIEWS, load
from plumbline import ProfileOptions, profile_table, profile_tables
from plumbline.operators import profile as P
from plumbline.operators.isolation import profile_isolated
from plumbline.sources import catalog

PROFILED = [t for t in VIEWS if t in TABLES] + ["labelled", "order_sheet"]


def inputs(spark, sf_dir, names) -> dict[str, DataFrame]:
    return {n: VIEWS[n].build(spark, sf_dir) for n in names}


def presentable(profile: DataFrame) -> DataFrame:
    """Profile rows for comparison: moments rounded, flags as one text."""
    return profile.drop("top_values").withColumns(
        {
            "mean_val": F.round("mean_val", 4),
            "std_val": F.round("std_val", 4),
            "pattern_flags": F.concat_ws(",", "pattern_flags"),
        }
    )


def _profile(view, **options):
    def run(spark, sf_dir):
        df = VIEWS[view].build(spark, sf_dir)
        return presentable(profile_table(view, df, ProfileOptions(**options)))

    return run


def _top(view, **options):
    def run(spark, sf_dir):
        df = VIEWS[view].build(spark, sf_dir)
        return P.top_values(profile_table(view, df, ProfileOptions(**options)))

    return run


def _numbers(rule):
    """Which text of an order sheet counts as a number, and its moments."""

    def run(spark, sf_dir):
        profile = profile_tables(inputs(spark, sf_dir, ["order_sheet"]), ProfileOptions(number_rule=rule))
        return profile.select(
            "column", F.round("mean_val", 4).alias("mean_val"), F.round("std_val", 4).alias("std_val")
        )

    parts = [
        f"""SELECT '{c}' AS "column", round(avg({S.number(c, k, rule)}), 4) AS mean_val,
            round(stddev_samp({S.number(c, k, rule)}), 4) AS std_val FROM data"""
        for c, k in VIEWS["order_sheet"].columns
    ]
    sql = S.with_ctes([f"data AS ({VIEWS['order_sheet'].sql})"], " UNION ALL ".join(parts))
    return run, sql


def _band_case(name: str) -> str:
    return f"CASE WHEN {name} >= 0.5 THEN 'red' WHEN {name} >= 0.2 THEN 'amber' ELSE 'green' END"


EXPECTED = {"order_sheet": {"id": "integer", "total": "VARCHAR", "placed": "VARCHAR", "status": "VARCHAR"}}


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in TABLES)


def _listing(spark, sf_dir):
    tables = {t: load(spark, sf_dir, t) for t in TABLES}
    listing = catalog.describe_tables(tables).join(catalog.row_counts(tables), "table")
    return listing.select("table", "column", "ordinal", "declared_type", "row_count")


def register() -> dict[str, tuple]:
    """name -> (query, oracle SQL or None)"""
    q: dict[str, tuple] = {}

    q["schema_listing"] = (
        _listing,
        """SELECT table_name AS "table", column_name AS "column", CAST(ordinal_position - 1 AS INTEGER) AS ordinal, row_count,
                  CASE WHEN data_type IN ('SMALLINT','INTEGER','BIGINT') THEN 'integer'
                       WHEN data_type IN ('FLOAT','DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'float'
                       WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'DATE' THEN 'date'
                       WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END AS declared_type
           FROM information_schema.columns JOIN ("""
        + _COUNTS
        + """) c ON c."table" = table_name""",
    )
    q["row_counts"] = (
        lambda s, d: catalog.row_counts({t: load(s, d, t) for t in TABLES}),
        _COUNTS,
    )
    q["ordered_sample"] = (
        lambda s, d: catalog.sample_rows(load(s, d, "orders"), 1000, ["o_totalprice", "o_orderkey"]),
        "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1000",
    )
    for view in PROFILED:
        q[f"profile_{view}"] = (_profile(view), S.profile_sql(view))
    q["profile_all_tables"] = (
        lambda s, d: presentable(profile_tables(inputs(s, d, PROFILED))),
        S.profiles_sql(PROFILED),
    )
    def with_failures(s, d):
        """Orders with two columns that raise an error in some row, beside other tables."""
        bad = load(s, d, "orders").selectExpr(
            "o_orderkey", "CAST(IF(o_orderkey = 7, 'x', '1') AS INT) AS unreadable", "o_custkey", "o_orderstatus",
            "o_totalprice", "o_orderdate", "100 / (o_custkey - 11) AS undefined", "o_orderpriority",
        )
        return profile_isolated({"orders": bad, "nation": load(s, d, "nation"), "customer": load(s, d, "customer")})

    # ordinals count the columns that fail, too
    seen = S.profiles_sql(["orders", "nation", "customer"])
    shifted = "CAST(ordinal + CASE WHEN \"table\" = 'orders' THEN CASE WHEN ordinal > 4 THEN 2 WHEN ordinal > 0 THEN 1 ELSE 0 END ELSE 0 END AS INTEGER)"
    q["profile_beside_failing_columns"] = (
        lambda s, d: presentable(with_failures(s, d)[0]),
        f"SELECT * REPLACE ({shifted} AS ordinal) FROM ({seen})",
    )
    q["profile_failing_columns"] = (
        lambda s, d: with_failures(s, d)[1].select("table", "column", F.length("error").cast("boolean").alias("has_error")),
        """SELECT 'orders' AS "table", c AS "column", true AS has_error FROM (VALUES ('unreadable'), ('undefined')) AS v(c)
           WHERE EXISTS (SELECT 1 FROM orders WHERE c = 'unreadable' AND o_orderkey = 7 OR c = 'undefined' AND o_custkey = 11)""",
    )
    q["profile_headed_texts"] = (_profile("headed_texts"), S.profile_sql("headed_texts"))
    q["profile_population_deviation"] = (
        _profile("lineitem", deviation="population"),
        S.profile_sql("lineitem", deviation="stddev_pop"),
    )
    q["profile_expected_types"] = (
        lambda s, d: presentable(profile_tables(inputs(s, d, ["order_sheet"]), expected_types=EXPECTED)),
        S.profile_sql("order_sheet", expected=EXPECTED["order_sheet"]),
    )
    for view in ("orders", "lineitem", "documents", "pages", "conversations", "labelled", "headed_texts"):
        q[f"top_values_{view}"] = (_top(view), S.top_sql(view))
    q["top_values_share_of_all_rows"] = (
        _top("labelled", pct_base="all"),
        S.top_sql("labelled", base="all"),
    )
    q["top_values_for_display"] = (
        lambda s, d: P.top_values(profile_table("events", load(s, d, "events"))).where("rank <= 5"),
        S.with_ctes(S.profile_ctes("events"), S.TOP_BODY.replace("{tag}", "") + " WHERE r.rnk <= 5"),
    )
    q["numbers_in_text_lenient"] = _numbers("lenient")
    q["numbers_in_text_plain"] = _numbers("plain")
    q["table_shapes"] = (
        lambda s, d: P.table_shapes(profile_tables(inputs(s, d, ["labelled", "orders", "nation"]))),
        " UNION ALL ".join(
            f"SELECT '{v}' AS \"table\", count(*) AS rows, CAST({len(VIEWS[v].columns)} AS BIGINT) AS columns "
            f"FROM ({VIEWS[v].sql})"
            for v in ("labelled", "orders", "nation")
        ),
    )
    q["null_bands"] = (
        lambda s, d: profile_table("labelled", VIEWS["labelled"].build(s, d)).select(
            "column", "null_pct", P.null_band(F.col("null_pct")).alias("band")
        ),
        S.with_ctes(
            S.profile_ctes("labelled"), f'SELECT "column", null_pct, {_band_case("null_pct")} AS band FROM profile'
        ),
    )
    return q
