import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import profile_tables
from plumbline.operators import findings as FD
from plumbline.sources import catalog, files, jdbc
from plumbline.sources.settle import settle


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alice", 1.5), (2, None, None)], "id int, name string, x double")
    path = files.write_cleaned(df, str(tmp_path))
    assert path.split("/")[-1].startswith("cleaned_")
    back = files.read_csv(spark, path)
    assert back.dtypes == [("id", "int"), ("name", "string"), ("x", "double")]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert files.read_csv(spark, path, schema="id string, name string, x string").dtypes[0] == ("id", "string")


def test_headers():
    assert files.clean_headers(["a", " a ", None, "", "A", "a_1", 5]) == [
        "a", "a_1", "col_2", "col_3", "A_2", "a_1_1", "5",
    ]


def test_sheet_pads_and_cuts_rows(spark):
    lines = spark.createDataFrame(
        [(0, "id|id||note"), (1, "1|2|3|x"), (2, "4"), (3, "5||7|y|extra")], "number int, line string"
    )
    table = files.sheet(spark, lines, sep="|")
    assert table.columns == ["id", "id_1", "col_2", "note", "col_4"]
    assert sorted(map(tuple, table.collect())) == [
        ("1", "2", "3", "x", None), ("4", None, None, None, None), ("5", None, "7", "y", "extra"),
    ]


@pytest.mark.parametrize("sep", [",", "||"])
def test_quoted_cells_of_sheets(spark, sep):
    rows = ['a,"b,c",d', '1,"x,y",3', '"say ""hi""",,"",', '5"",",6', '"7"8,"9', "", None, f'"{"long, " * 5000}"']
    rows = [r if r is None else r.replace(",", sep) for r in rows]
    lines = spark.createDataFrame(list(enumerate(rows)), "number int, line string")
    table = files.sheet(spark, lines, sep)
    assert table.columns == ["a", f"b{sep}c", "d", "col_3"]
    found = {tuple(r) for r in table.collect()}
    assert found == {
        ("1", f"x{sep}y", "3", None), ('say "hi"', None, None, None), ('5""', '"', "6", None), ('"7"8', '"9', None, None),
        (None, None, None, None), (f"long{sep} " * 5000, None, None, None),
    }


def test_sheet_of_headers_only(spark):
    lines = spark.createDataFrame([(0, "a,a")], "number int, line string")
    table = files.sheet(spark, lines)
    assert table.columns == ["a", "a_1"] and table.count() == 0


def test_everything_as_text(spark):
    df = spark.createDataFrame([(1, True, [1])], "A int, a_ boolean, l array<int>")
    assert files.as_text(df).collect() == [("1", "true", "[1]")]


@pytest.mark.parametrize(
    "dsn, url, quoted",
    [
        ("postgres://u:p%40ss@db/shop", "jdbc:postgresql://db:5432/shop", '"or""der"'),
        ("mysql://u:p%40ss@db:3307/shop", "jdbc:mysql://db:3307/shop", '`or"der`'),
        (
            "mssql://u:p%40ss@db/shop",
            "jdbc:sqlserver://db:1433;databaseName=shop;applicationIntent=ReadOnly",
            '[or"der]',
        ),
    ],
)
def test_jdbc_options(dsn, url, quoted):
    connection = jdbc.Connection.parse(dsn)
    options = jdbc.table_options(connection, 'or"der', jdbc.Split("id", 0, 1000, 8))
    assert options["url"] == url and options["dbtable"] == quoted
    assert (options["user"], options["password"]) == ("u", "p@ss")
    assert (options["numPartitions"], options["lowerBound"], options["upperBound"]) == ("8", "0", "1000")
    assert ("sessionInitStatement" in options) == (connection.kind != "mssql")
    assert "BASE TABLE" in jdbc.listing_options(connection)["query"]
    assert "key_columns" in jdbc.key_catalog_options(connection)


def test_unknown_database():
    with pytest.raises(ValueError):
        jdbc.Connection.parse("oracle://db/shop")


def test_listing_counts_and_sample(spark):
    tables = {"b": spark.range(5), "a": spark.createDataFrame([(1.5,)], "x float")}
    listing = catalog.describe_tables(tables).collect()
    assert [(r["table"], r["column"], r["declared_type"]) for r in listing] == [("b", "id", "integer"), ("a", "x", "float")]
    assert {tuple(r) for r in catalog.row_counts(tables).collect()} == {("b", 5), ("a", 1)}
    sample = catalog.sample_rows(tables["b"], 3, [F.desc("id")])
    assert [r["id"] for r in sample.collect()] == [4, 3, 2]


def test_results_are_saved(spark, tmp_path):
    profile = profile_tables({"t": spark.range(3), "u": spark.range(4)})
    findings = spark.createDataFrame([], FD.SCHEMA)
    paths = files.save_results(profile, findings, str(tmp_path))
    back = spark.read.parquet(paths["profile"])
    assert {(r["table"], r["row_count"]) for r in back.collect()} == {("t", 3), ("u", 4)}


def test_settled_results_do_not_recompute(spark):
    counter = spark.sparkContext.accumulator(0)

    def seen(rows):
        for row in rows:
            counter.add(1)
            yield row

    df = spark.createDataFrame(spark.range(4).rdd.mapPartitions(seen), "id bigint")
    done = settle(df)
    before = counter.value
    assert done.count() == 4 and done.collect() and counter.value == before


def test_bounds_follow_the_keys_own_distribution(spark):
    """Nine tenths of the keys lie in a hundredth of the range, one value holds a fifth of all rows."""
    keys = spark.range(10000).selectExpr(
        "CASE WHEN id % 5 = 0 THEN 7 WHEN id % 10 = 1 THEN id * 1000 ELSE id END AS k", "CAST(id AS STRING) AS t",
        "date_add(DATE'2024-01-01', CAST(sqrt(id) AS INT)) AS day",
    )
    connection = jdbc.Connection.parse("postgres://db/shop")
    for column in ("k", "day"):
        bounds = jdbc.equal_depth_bounds(keys, column, 8)
        predicates = jdbc.range_predicates(connection, column, bounds)
        counts = [keys.where(p.replace('"', "`")).count() for p in predicates]
        assert sum(counts) == 10000 and len(predicates) <= 8
        assert max(counts) <= 10000 / 8 * (2.2 if column == "k" else 1.2)
    assert jdbc.equal_depth_bounds(keys, "t", 8) is None
    assert jdbc.equal_depth_bounds(keys.limit(0), "k", 4) == [] and jdbc.range_predicates(connection, "k", []) == ["1 = 1"]


def test_range_predicates_hold_each_row_once(spark):
    connection = jdbc.Connection.parse("mysql://db/shop")
    rows = spark.createDataFrame([(None,), (-5,), (0,), (3,), (3,), (9,)], "k int")
    predicates = jdbc.range_predicates(connection, "k", [0, 3])
    assert [rows.where(p).count() for p in predicates] == [2, 1, 3]
    assert jdbc.range_predicates(connection, "d", [dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5)])[1] == (
        "`d` >= '2024-01-02' AND `d` < '2024-01-02T03:04:05.000'"
    )


@pytest.mark.parametrize("dsn", ["postgres://db/shop", "mysql://db/shop", "mssql://db/shop"])
def test_hash_predicates_and_schemas(dsn):
    connection = jdbc.Connection.parse(dsn)
    predicates = jdbc.hash_predicates(connection, "code", 4)
    assert len(predicates) == 4 and "IS NULL" in predicates[0] and all(p.startswith(predicates[0][:20]) for p in predicates)
    quoted = connection.quote
    assert jdbc.table_options(connection, "t", schema="s")["dbtable"] == f"{quoted('s')}.{quoted('t')}"
    assert "table_schema" in jdbc.listing_options(connection)["query"]
    assert jdbc.source_names([("a", "t"), ("b", "t"), ("a", "u")]) == {"a.t": ("a", "t"), "b.t": ("b", "t"), "u": ("a", "u")}
