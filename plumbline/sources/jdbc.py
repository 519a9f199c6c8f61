"""JDBC reads: options per database, split reads, catalog tables.

Nothing here connects; the functions build the options that ``spark.read``
takes, so that a scan is split into ranges and runs read-only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# URL prefix, default port, driver class, read-only session statement.
DATABASES = {
    "postgresql": (
        "jdbc:postgresql://{host}:{port}/{database}",
        5432,
        "org.postgresql.Driver",
        "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY",
    ),
    "mysql": (
        "jdbc:mysql://{host}:{port}/{database}",
        3306,
        "com.mysql.cj.jdbc.Driver",
        "SET SESSION TRANSACTION READ ONLY",
    ),
    "mssql": (
        "jdbc:sqlserver://{host}:{port};databaseName={database};applicationIntent=ReadOnly",
        1433,
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        None,
    ),
}
ALIASES = {"postgres": "postgresql", "sqlserver": "mssql"}


@dataclass(frozen=True)
class Connection:
    """A parsed ``kind://user:password@host:port/database`` address."""

    kind: str
    host: str
    port: int
    database: str
    user: str | None
    password: str | None

    @classmethod
    def parse(cls, dsn: str) -> Connection:
        parts = urlsplit(dsn)
        scheme = parts.scheme.split("+")[0]
        kind = ALIASES.get(scheme, scheme)
        if kind not in DATABASES:
            raise ValueError(f"unknown database kind {scheme!r}")
        return cls(
            kind,
            parts.hostname or "localhost",
            parts.port or DATABASES[kind][1],
            parts.path.lstrip("/"),
            unquote(parts.username) if parts.username else None,
            unquote(parts.password) if parts.password else None,
        )

    def options(self) -> dict[str, str]:
        """Connection options, read-only where the database can be told so."""
        url, _, driver, read_only = DATABASES[self.kind]
        out = {
            "url": url.format(host=self.host, port=self.port, database=self.database),
            "driver": driver,
            "fetchsize": "10000",
        }
        if self.user:
            out["user"] = self.user
        if self.password:
            out["password"] = self.password
        if read_only:
            out["sessionInitStatement"] = read_only
        return out

    def quote(self, name: str) -> str:
        if self.kind == "mysql":
            return "`" + name.replace("`", "``") + "`"
        if self.kind == "mssql":
            return "[" + name.replace("]", "]]") + "]"
        return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Split:
    """How to cut a table into parallel range reads."""

    column: str
    lower: int
    upper: int
    partitions: int


def table_options(
    connection: Connection, table: str, split: Split | None = None, schema: str | None = None
) -> dict[str, str]:
    """Options of a table scan. Without a split the whole table is one task."""
    out = connection.options() | {"dbtable": qualified(connection, table, schema)}
    if split:
        out |= {
            "partitionColumn": connection.quote(split.column),
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return out


def qualified(connection: Connection, table: str, schema: str | None = None) -> str:
    """The table's quoted name, within its schema where one is given."""
    return ".".join(connection.quote(n) for n in (schema, table) if n)


# --- splits without an even number range -----------------------------------------

# SQL of a non-negative hash of a column, below {n}.
_HASHES = {
    "postgresql": "mod(mod(hashtext(CAST({column} AS text)), {n}) + {n}, {n})",
    "mysql": "mod(crc32({column}), {n})",
    "mssql": "((CHECKSUM({column}) % {n}) + {n}) % {n}",
}
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def equal_depth_bounds(keys: DataFrame, column: str, partitions: int) -> list | None:
    """Values that cut a table into ``partitions`` ranges of about equally many rows, from a sample of
    its key. None for a key that is neither a number nor a date: those are dealt by hash.

    The sample's distribution decides, so gaps and crowded ranges of the key do not make uneven tasks. A
    value that holds several shares by itself bounds one range only.
    """
    if partitions < 2 or not isinstance(keys.schema[column].dataType, _ORDERED):
        return None if partitions > 1 else []
    shares = [i / partitions for i in range(1, partitions)]
    found = keys.agg(F.percentile_approx(F.col(f"`{column}`"), shares, 100 * partitions)).first()[0]
    return sorted(set(found or []))


def range_predicates(connection: Connection, column: str, bounds: list) -> list[str]:
    """A predicate per task; together they hold each row once, NULL keys in the first."""
    name = connection.quote(column)
    if not bounds:
        return ["1 = 1"]
    shown = [_literal(b) for b in bounds]
    between = [f"{name} >= {low} AND {name} < {high}" for low, high in zip(shown, shown[1:])]
    return [f"{name} < {shown[0]} OR {name} IS NULL", *between, f"{name} >= {shown[-1]}"]


def hash_predicates(connection: Connection, column: str, partitions: int) -> list[str]:
    """As :func:`range_predicates`, for keys without a useful order."""
    name = connection.quote(column)
    value = _HASHES[connection.kind].format(column=name, n=partitions)
    return [f"{value} = {i}" + (f" OR {name} IS NULL" if i == 0 else "") for i in range(partitions)]


def _literal(value) -> str:
    """A number or date as SQL that all three databases read; dates in ISO form."""
    if isinstance(value, (bool, str)):
        raise ValueError(f"no bound: {value!r}")
    if isinstance(value, dt.datetime):
        return f"'{value.isoformat(sep='T', timespec='milliseconds')}'"
    if isinstance(value, dt.date):
        return f"'{value.isoformat()}'"
    return format(value, "f") if isinstance(value, Decimal) else repr(value)


def read_split(
    spark: SparkSession, connection: Connection, table: str, column: str, partitions: int, keys: DataFrame, schema: str | None = None
) -> DataFrame:
    """The table in ``partitions`` tasks by ``column``, of which ``keys`` is a sample."""
    bounds = equal_depth_bounds(keys, column, partitions)
    predicates = hash_predicates(connection, column, partitions) if bounds is None else range_predicates(connection, column, bounds)
    options = connection.options()
    return spark.read.jdbc(options.pop("url"), qualified(connection, table, schema), predicates=predicates, properties=options)


# Catalog queries per database.
_TABLES = {
    "postgresql": "SELECT table_schema, table_name FROM information_schema.tables "
    "WHERE table_schema = 'public' AND table_type = 'BASE TABLE'",
    "mysql": "SELECT table_schema AS table_schema, table_name AS table_name FROM information_schema.tables "
    "WHERE table_schema = DATABASE() AND table_type = 'BASE TABLE'",
    "mssql": "SELECT table_schema AS table_schema, table_name AS table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
}
_KEY_TABLES = {
    "postgresql": {
        "constraints": "information_schema.table_constraints",
        "key_columns": "information_schema.key_column_usage",
        "target_columns": "information_schema.constraint_column_usage",
        "references": "information_schema.referential_constraints",
    },
    "mysql": {
        "key_columns": "information_schema.KEY_COLUMN_USAGE",
        "constraints": "information_schema.TABLE_CONSTRAINTS",
    },
    "mssql": {"key_columns": "sys.foreign_key_columns", "tables": "sys.tables", "columns": "sys.columns"},
}


def listing_options(connection: Connection) -> dict[str, str]:
    """Options that read the names of the base tables; order the result by name."""
    return connection.options() | {"query": _TABLES[connection.kind]}


def key_catalog_options(connection: Connection) -> dict[str, Mapping[str, str]]:
    """Options per catalog table that the ``declared_keys_*`` operators take."""
    return {
        name: connection.options() | {"dbtable": table} for name, table in _KEY_TABLES[connection.kind].items()
    }


def read(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def read_source(
    spark: SparkSession, connection: Connection, splits: Mapping[str, Split] | None = None
) -> dict[str, DataFrame]:
    """All base tables by name. Only the table names reach the driver.

    A name that several schemas use is told apart by its schema (``schema.table``)."""
    rows = read(spark, listing_options(connection)).orderBy("table_name", "table_schema").collect()
    splits, named = splits or {}, source_names([(r["table_schema"], r["table_name"]) for r in rows])
    return {n: read(spark, table_options(connection, table, splits.get(n), schema)) for n, (schema, table) in named.items()}


def source_names(tables: list[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """A name for each (schema, table)."""
    often = [table for _, table in tables]
    return {table if often.count(table) == 1 else f"{schema}.{table}": (schema, table) for schema, table in tables}
