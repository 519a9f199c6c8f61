"""The rows behind a finding, for a person to look at.

A rule over single rows leaves a predicate. What a rule over groups has found is a group of rows
or a missing partner, so its rows are had by joining the table with the keys of the groups in
question, which are counted before: a key of very many rows is one row of that side.
Enrichment findings are claims that every row bears out; no row offends against them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import column_ref
from plumbline.operators import findings as FD
from plumbline.operators.orphans import orphan_rows
from plumbline.sources.settle import settle


def repeated_key_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key another row has, too; a key with a NULL part is none."""
    return _sharing(df, [column_ref(c) for c in key], complete=True)


def repeated_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows that are equal to another one on all columns but ``ignore``. NULLs are equal here."""
    compared = [f for f in df.schema.fields if f.name not in ignore]
    if not compared:
        return df.limit(0)
    values = F.struct(*[_comparable(column_ref(f.name), f.dataType).alias(f"v{i}") for i, f in enumerate(compared)])
    # whole rows travel as a digest; fields are told apart by their names
    digest = F.sha2(F.to_json(values), 256)
    return _sharing(df, [digest], complete=False)


def _comparable(value: Column, dtype: T.DataType) -> Column:
    return F.hex(value) if isinstance(dtype, T.BinaryType) else value


def _sharing(df: DataFrame, parts: Sequence[Column], complete: bool) -> DataFrame:
    names, n = [], 0
    while len(names) < len(parts):  # no name of the table's own
        if f"key_{n}".lower() not in {c.lower() for c in df.columns}:
            names.append(f"key_{n}")
        n += 1
    keyed = df.select("*", *[p.alias(n) for p, n in zip(parts, names)])
    if complete:
        keyed = keyed.dropna(subset=names)
    shared = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("rows_of_key")).where("rows_of_key > 1").select(*names)
    # stored, so that the join below it is one that Spark may deal anew if a key is held by very many rows
    shared = settle(shared, bounded=False)
    return keyed.join(shared, names, "left_semi").select(*[column_ref(c) for c in df.columns])


def offending_rows(
    tables: Mapping[str, DataFrame],
    finding: Row,
    keys: Mapping[str, Sequence[str]] | None = None,
    relations: Sequence[Row] = (),
) -> DataFrame | None:
    """The rows a finding is about; None if it is not about some rows of one table.

    ``keys`` are the tables' keys, as for the rules (a finding that names a key of its own needs none);
    ``relations`` (from and to table and column) tell an orphan's parent.
    """
    table = finding["tables"][0]
    df, column = tables[table], finding["column"]
    if finding["investigation"]:
        return df.where(F.expr(finding["investigation"]))
    if finding["kind"] != FD.QUALITY:
        return None
    code = finding["code"]
    if code == "POSSIBLE_DUPLICATE" and column is None:
        return repeated_rows(df, (keys or {}).get(table, ()))
    if code == "POSSIBLE_DUPLICATE":
        return repeated_key_rows(df, [column] if column in df.columns else (keys or {})[table])
    if code == "CARDINALITY_ANOMALY":
        return repeated_key_rows(df, [column])
    if code == "ORPHANED_FK":
        for r in relations:
            if (r["from_table"], r["from_column"]) == (table, column) and finding["description"].endswith(f" {r['to_table']}"):
                return orphan_rows(df, [column], tables[r["to_table"]], [r["to_column"]])
        raise ValueError(f"no relation of {table}.{column} is given")
    if code in ("ALL_NULL", "NULL_CRITICAL", "NULL_EXCESS"):
        return df.where(column_ref(column).isNull())
    return None
