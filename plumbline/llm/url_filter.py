"""Allow and block rules over URLs, by hashed host-suffix and path-prefix expressions.

DataFrame functions only. A distinct (host, path) becomes one expression for each suffix of
its host and each length a rule's path has; the expressions meet the rules on the first
eight hex digits of SHA-256, then the whole digests are compared. Of the rules that fit,
the longest wins, on equal length a block, then the first in order of text.

A null URL, or one without ``://``, has an empty host and path, which only a rule of an
empty host fits. Repeated rows are judged once a row. A URL without a rule gets ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import settle

# Host and path of each rule, and what it says.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Hex digits of the digest that expressions and rules are joined on.
SHORT = 8


def rules(spark: SparkSession, rows: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rule_rows: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (or null), verdict."""
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    named = named.select("page_id", host.alias("host"), path.alias("path"))
    # as many lengths as rules' paths have, which the length of a URL bounds
    lengths = sorted(r[0] for r in rule_rows.select(F.length("path")).distinct().collect())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path"))
    distinct = named.select("host", "path").distinct()
    expressions = distinct.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"), cuts.alias("cuts"))
    expressions = expressions.select("host", "path", "suffix", F.explode("cuts").alias("cut"))
    # a line feed, which neither a host nor a rule's host has, parts host and path
    digest = F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(path, 1, cut)")), 256)
    expressions = expressions.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, SHORT))
    held = rule_rows.select(
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("whole"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    held = held.withColumn("short", F.substring("whole", 1, SHORT))
    fit = expressions.join(held, "short").filter("digest = whole")
    best = fit.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("size"), (F.col("verdict") != "block").alias("mild"), "rule", "verdict")).alias("best")
    )
    # as a table, so that both sides of the join come from shuffles: Spark splits what one URL,
    # or rows without any, make large
    return named.join(settle(best), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


#: DuckDB SQL for the registered query, of ``pages``.
SQL = f"""
WITH r(rhost, rpath, says) AS (VALUES {", ".join(str(r) for r in RULES)}),
a AS (
    SELECT page_id, row_number() OVER () AS n,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, n, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
    SELECT n, rhost || rpath AS rule, says, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
    FROM b JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict
FROM b LEFT JOIN (SELECT * FROM c WHERE k = 1) USING (n)
"""
