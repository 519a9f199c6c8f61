"""Named inputs of the registered queries, as a DataFrame and as SQL.

The driver tables have no NULLs, prefixed column names and clean keys; these
views over whole tables bring in what the operators look for: gaps, text-only
columns, entity-style names, derived and repeated columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Column -> (catalog type, canonical label) of the driver tables.
_TYPES = {
    "bigint": "integer",
    "int": "integer",
    "double": "float",
    "string": "string",
    "timestamp": "datetime",
    "boolean": "boolean",
    "date": "date",
}


@dataclass(frozen=True)
class View:
    """A named input: how Spark builds it, its SQL, and (column, type) pairs."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str
    columns: tuple[tuple[str, str], ...]

    def label(self, column: str) -> str:
        return _TYPES[dict(self.columns)[column]]


_HANDLES: dict[tuple[str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Table handle; its schema is read from the file once per application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{table}.parquet")
    if key not in _HANDLES:
        _HANDLES[key] = spark.read.parquet(key[1])
    return _HANDLES[key]


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(item.split(":")) for item in text.split())


_PLAIN = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double "
    "o_orderdate:timestamp o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double "
    "l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string "
    "l_shipdate:timestamp",
    "events": "event_id:bigint ts:timestamp user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}


def _plain(table: str) -> View:
    return View(lambda s, d: load(s, d, table), f"SELECT * FROM {table}", _columns(_PLAIN[table]))


def _renamed(table: str, pairs: str, columns: str) -> View:
    """Projection of one table: ``new=expression`` items, valid in both dialects."""
    items = [p.strip().split("=", 1) for p in pairs.split(";")]
    sql = ", ".join(f"{e} AS {n}" for n, e in items)
    return View(
        lambda s, d: load(s, d, table).select(*[F.expr(e).alias(n) for n, e in items]),
        f"SELECT {sql} FROM {table}",
        _columns(columns),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "documents")
        .join(load(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            "doc_id",
            "lang",
            F.nullif("source", F.lit("src1")).alias("source"),
            F.when(F.col("n_chars") > 900, F.col("n_chars")).alias("long_chars"),
            "quality",
            "toxic",
            F.lit(None).cast("string").alias("reviewer"),
            (F.col("n_chars") > 1000).alias("is_long"),
            "text",
        )
    )


# The two engines write small fractions differently; in this unit every component from 2 ** -36 on is a
# whole number (24 bits of fraction), so the texts are equal where the vectors are.
_UNIT = 1 << 60


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(_UNIT)).cast("string"))
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.array_join(whole, " ").alias("embedding"))


VIEWS: dict[str, View] = {t: _plain(t) for t in _PLAIN}
VIEWS |= {
    "embeddings": View(
        _embeddings,
        f"""SELECT vec_id, label, array_to_string([CAST(floor(CAST(x AS DOUBLE) * {_UNIT}.0) AS BIGINT) for x in embedding], ' ')
                   AS embedding FROM embeddings""",
        _columns("vec_id:bigint label:int embedding:string"),
    ),
    # gaps: outer join and NULLed values, an empty column, a boolean
    "labelled": View(
        _labelled,
        """SELECT d.doc_id, d.lang, nullif(d.source, 'src1') AS source,
                  CASE WHEN d.n_chars > 900 THEN d.n_chars END AS long_chars,
                  l.quality, l.toxic, CAST(NULL AS VARCHAR) AS reviewer, d.n_chars > 1000 AS is_long, d.text
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        _columns(
            "doc_id:bigint lang:string source:string long_chars:bigint quality:int toxic:int "
            "reviewer:string is_long:boolean text:string"
        ),
    ),
    # every column as text, as a spreadsheet import delivers it
    "order_sheet": _renamed(
        "orders",
        "id=CAST(o_orderkey AS VARCHAR(20)); total=CAST(o_totalprice AS VARCHAR(20));"
        "placed=substring(CAST(o_orderdate AS VARCHAR(40)), 1, 10);"
        "urgent=CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'no' END;"
        "code=CASE WHEN o_custkey % 7 = 0 THEN o_orderstatus ELSE CAST(o_custkey % 5 AS VARCHAR(20)) END;"
        "status=o_orderstatus",
        "id:string total:string placed:string urgent:string code:string status:string",
    ),
    # entity-style names for the relationship rules
    "customers": _renamed(
        "customer",
        "id=c_custkey; name=c_name; nation_id=c_nationkey; segment=c_mktsegment; balance=c_acctbal",
        "id:bigint name:string nation_id:int segment:string balance:double",
    ),
    "sales": _renamed(
        "orders",
        "id=o_orderkey; customer_id=o_custkey; status=o_orderstatus; total=o_totalprice;"
        "placed=o_orderdate; priority=o_orderpriority",
        "id:bigint customer_id:bigint status:string total:double placed:timestamp priority:string",
    ),
    "nations": _renamed(
        "nation", "id=n_nationkey; name=n_name; region_key=n_regionkey", "id:int name:string region_key:int"
    ),
    "region_list": _renamed("region", "id=r_regionkey; name=r_name", "id:int name:string"),
    "suppliers": _renamed(
        "supplier",
        "supplier_id=s_suppkey; nation_fk=CAST(s_nationkey AS VARCHAR(20)); balance=s_acctbal; name=s_name",
        "supplier_id:bigint nation_fk:string balance:double name:string",
    ),
    "sale_lines": _renamed(
        "lineitem",
        "sale_id=l_orderkey; supplier_id=l_suppkey; line_no=l_linenumber; quantity=l_quantity; part_no=l_partkey;"
        "price=l_extendedprice; discount=l_discount; tax=l_tax; returned=l_returnflag; status=l_linestatus; shipped=l_shipdate",
        "sale_id:bigint supplier_id:bigint line_no:int quantity:double part_no:bigint price:double discount:double "
        "tax:double returned:string status:string shipped:timestamp",
    ),
}

# One table with planted defects of every kind, derived from all orders.
_QUANTITY = "CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE o_custkey % 9 + 1 END"
VIEWS["intake"] = _renamed(
    "orders",
    "intake_id=CASE WHEN o_orderkey % 40 = 7 THEN o_orderkey - 1 ELSE o_orderkey END;"
    "customer_id=o_custkey;"
    "placed=CASE WHEN o_orderkey % 10 = 0 THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', "
    "year(o_orderdate)) ELSE substring(CAST(o_orderdate AS VARCHAR(40)), 1, 10) END;"
    "email=concat('user', o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN '_at_' ELSE '@' END, 'example.com');"
    "priority=CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 13 = 0 "
    "THEN concat(' ', o_orderpriority) ELSE o_orderpriority END;"
    "amount=CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END;"
    f"quantity={_QUANTITY};"
    "price=o_totalprice;"
    f"line_total=CASE WHEN o_orderkey % 333 = 0 THEN 1.0 ELSE 0.0 END + ({_QUANTITY}) * o_totalprice;"
    "code=CASE WHEN o_custkey % 7 = 0 THEN o_orderstatus ELSE CAST(o_custkey % 5 AS VARCHAR(20)) END;"
    "note=CAST(NULL AS VARCHAR(20));"
    "phone=CASE WHEN o_orderkey % 4 <> 0 THEN concat('555-01', CAST(o_custkey % 90 + 10 AS VARCHAR(20))) END;"
    "channel=CASE WHEN o_orderkey % 16 <> 0 THEN o_orderstatus END;"
    "reviewer=CASE WHEN o_orderkey % 5 < 2 THEN concat('R', CAST(o_custkey % 10 AS VARCHAR(20))) END;"
    "agent=CASE WHEN o_orderkey % 200 <> 0 THEN concat('A', CAST(o_custkey % 10 AS VARCHAR(20))) END",
    "intake_id:bigint customer_id:bigint placed:string email:string priority:string amount:double "
    "quantity:bigint price:double line_total:double code:string note:string phone:string channel:string "
    "reviewer:string agent:string",
)
# texts repeated under different ids
VIEWS["passages"] = _renamed(
    "documents",
    "passage_id=doc_id; text=text; lang=lang; source=source; n_chars=n_chars",
    "passage_id:bigint text:string lang:string source:string n_chars:bigint",
)
# products, copies and dependencies
VIEWS["invoice"] = _renamed(
    "lineitem",
    "order_no=l_orderkey; part_no=l_partkey; quantity=l_quantity; price=l_extendedprice;"
    "total=l_quantity * l_extendedprice; qty_copy=l_quantity; shelf=l_partkey % 10; half=l_quantity / 2;"
    "currency='EUR'; flag=l_returnflag; grade=CASE WHEN l_returnflag = 'A' THEN 'first' ELSE 'other' END",
    "order_no:bigint part_no:bigint quantity:double price:double total:double qty_copy:double shelf:bigint "
    "half:double currency:string flag:string grade:string",
)
# figures that begin late, and two kinds of rows that fill different ones
VIEWS["late_figures"] = _renamed(
    "lineitem",
    "order_no=l_orderkey; quantity=l_quantity; price=l_extendedprice;"
    "total=CASE WHEN l_orderkey % 5 > 0 THEN l_quantity * l_extendedprice END;"
    "early_fee=CASE WHEN l_linenumber < 4 THEN l_quantity * 2 END;"
    "late_rate=CASE WHEN l_linenumber >= 4 THEN l_quantity / 4 END;"
    "late_units=CASE WHEN l_linenumber >= 4 THEN l_partkey % 13 + 2 END;"
    "late_cost=CASE WHEN l_linenumber >= 4 THEN l_quantity / 4 * (l_partkey % 13 + 2) END;"
    "late_drift=CASE WHEN l_linenumber >= 4 THEN l_quantity / 4 * (l_partkey % 13 + 2) + "
    "CASE WHEN l_orderkey = 7 THEN 1 ELSE 0 END END",
    "order_no:bigint quantity:double price:double total:double early_fee:double late_rate:double "
    "late_units:bigint late_cost:double late_drift:double",
)
# texts that differ only far behind a common beginning
VIEWS["headed_texts"] = _renamed(
    "documents",
    "doc_id=doc_id; text=concat(repeat('= ', 100), text); lang=lang",
    "doc_id:bigint text:string lang:string",
)
# every kind of entity, from the rows' own numbers
VIEWS["contacts"] = _renamed(
    "customer",
    "id=c_custkey;"
    "line=CASE c_custkey % 8 WHEN 0 THEN concat('mail ', c_custkey, '@example.org now') "
    "WHEN 1 THEN concat('card 4111 1111 1111 ', 1000 + c_custkey % 9000) "
    "WHEN 2 THEN concat('ssn ', 100 + c_custkey % 900, '-12-', 1000 + c_custkey % 9000, '.') "
    "WHEN 3 THEN concat('from 10.0.', c_custkey % 256, '.7, and 10.1.2.3') "
    "WHEN 4 THEN concat('call +1 555 0', 100000 + c_custkey, ' or write') "
    "WHEN 5 THEN concat('see https://example.com/', c_custkey, '?q=1 and http://a.b') "
    "WHEN 6 THEN concat('pay DE', 10 + c_custkey % 90, '5001051754073249', 10 + c_custkey % 90, ' soon') "
    "ELSE c_name END",
    "id:bigint line:string",
)
