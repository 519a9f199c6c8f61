"""Profile of a source of which some columns cannot be read.

A column whose values raise an error (a cast in a view, a broken file) fails the plan it is part
of. The columns in question are halved until the culprits are alone: f of n columns cost
about f * log2(n) further profiles, each over the columns of its half only, and what a half
yields is kept. A source without errors costs nothing more.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import PROFILE_COLUMNS, ColumnSite, ProfileOptions, column_sites, profile_sites
from plumbline.operators.unions import union_all
from plumbline.sources.settle import settle

FAILURES = "`table` string, `column` string, error string"


def profile_isolated(
    tables: Mapping[str, DataFrame],
    options: ProfileOptions = ProfileOptions(),
    expected_types: Mapping[str, Mapping[str, str]] | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """Profile of all columns that can be read, settled (None if there are none), and
    (table, column, error) of the others; the column is NULL where no row of a table can be read."""
    tables = {name: df for name, df in tables.items() if df.columns}
    if not tables:
        raise ValueError("no columns to profile")
    work = [[s for group in column_sites(tables, expected_types).values() for s in group]]
    done: list[DataFrame] = []
    failed: list[tuple[str, str | None, str]] = []
    readable: set[str] = set()
    while work:
        sites = work.pop()
        try:
            done.append(settle(_profile_of(tables, sites, options)))
            continue
        except (PySparkException, Py4JJavaError) as error:
            reason = _reason(error)
        names = list(dict.fromkeys(s.table for s in sites))
        if len(names) > 1:
            first = set(names[: len(names) // 2])
            work += [[s for s in sites if s.table in first], [s for s in sites if s.table not in first]]
            continue
        if names[0] not in readable:
            try:
                tables[names[0]].agg(F.count(F.lit(1))).collect()
                readable.add(names[0])
            except (PySparkException, Py4JJavaError) as error:
                failed.append((names[0], None, _reason(error)))
                continue
        if len(sites) == 1:
            failed.append((sites[0].table, sites[0].name, reason))
        else:
            work += [sites[: len(sites) // 2], sites[len(sites) // 2 :]]
    spark = next(iter(tables.values())).sparkSession
    profile = union_all(done).select(*PROFILE_COLUMNS) if done else None
    return profile, spark.createDataFrame(sorted(failed, key=str), FAILURES)


def readable_columns(tables: Mapping[str, DataFrame], failures: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the columns and tables that failed: bounded by the schema."""
    bad = {(r["table"], r["column"]) for r in failures.collect()}
    out = {}
    for name, df in tables.items():
        kept = [c for c in df.columns if (name, c) not in bad]
        if (name, None) not in bad and kept:
            out[name] = df if len(kept) == len(df.columns) else df.drop(*[c for c in df.columns if c not in kept])
    return out


def _profile_of(tables: Mapping[str, DataFrame], sites: list[ColumnSite], options: ProfileOptions) -> DataFrame:
    chosen: dict[str, list[ColumnSite]] = {}
    for i, site in enumerate(sites):
        chosen.setdefault(site.table, []).append(replace(site, cid=i))
    return profile_sites({t: tables[t] for t in chosen}, chosen, options)


def _reason(error: Exception) -> str:
    """The innermost cause, in one line."""
    text = str(error.java_exception) if isinstance(error, Py4JJavaError) else str(error)
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    causes = [line for line in lines if line.startswith("Caused by:")]
    return (causes or lines or [type(error).__name__])[-1 if causes else 0][:300]
