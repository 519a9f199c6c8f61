"""Run registered queries against their SQL and compare whole results.

    python -m contract.compare [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

from contract.registry import registered
from contract.views import TABLES


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(f"{value:.10g}") + 0.0)
    if isinstance(value, bool) or not isinstance(value, int):
        return str(value)
    return repr(float(f"{value:.10g}"))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows {sum(mine.values())}", True
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", False
    theirs = rows_of(names, cursor.fetchall())
    if mine == theirs:
        return f"match {sum(mine.values())}", True
    a, b = list((mine - theirs).elements()), list((theirs - mine).elements())
    short = lambda x: [tuple(str(v)[:60] for v in r) for r in sorted(x, key=str)[:4]]
    return f"spark {sum(mine.values())} sql {sum(theirs.values())}\n   only spark {len(a)}: {short(a)}\n   only sql {len(b)}: {short(b)}", False


def main(argv):
    import duckdb

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, connection = session(), duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, (query, sql) in registered().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            text, ok = compare(spark, connection, sf_dir, query, sql)
        except Exception as error:  # report and go on
            text, ok = f"{type(error).__name__}: {str(error).splitlines()[0][:300]}", False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
