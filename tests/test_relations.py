import pytest

from plumbline import profile_tables
from plumbline.operators.orphans import orphan_counts, orphan_rows
from plumbline.operators.relations import infer_relations, relationship_map
from plumbline.sources import catalog
from tests.samples import shop


def rows(df):
    return {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]): r for r in df.collect()}


def make(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_plural_name_type_and_overlap(spark):
    ids = [(i,) for i in range(10)]
    tables = {
        "orders": make(spark, [(100 + i, i) for i in range(10)], "id int, user_id int"),
        "users": make(spark, ids, "id int"),
    }
    found = rows(infer_relations(profile_tables(tables)))
    assert set(found) == {("orders", "user_id", "users", "id")}
    row = found["orders", "user_id", "users", "id"]
    assert row["confidence"] == 0.9 and not row["is_declared"]
    assert row["evidence"] == ["name_match", "type_compatible", "value_overlap:1.00"]


def test_confidence_without_overlap_and_without_type(spark):
    tables = {
        "boxes": make(spark, [(i,) for i in range(50, 90)], "id int"),
        "a": make(spark, [(1,)], "box_id int"),
        "b": make(spark, [("x",)], "box_key string"),
    }
    found = rows(infer_relations(profile_tables(tables)))
    assert found["a", "box_id", "boxes", "id"]["confidence"] == 0.7
    assert found["b", "box_key", "boxes", "id"]["confidence"] == 0.5


def test_no_self_relation(spark):
    tables = {"orders": make(spark, [(1, 2)], "id int, order_id int")}
    assert infer_relations(profile_tables(tables)).count() == 0


def test_key_lookup_rules(spark):
    profile = profile_tables(shop(spark))
    assert infer_relations(profile).count() == 0  # customers.customer_id is not customers_id
    found = rows(infer_relations(profile, singular_names=True))
    assert set(found) == {
        ("orders", "customer_id", "customers", "customer_id"),
        ("order_items", "order_id", "orders", "order_id"),
        ("order_items", "product_id", "products", "product_id"),
    }


def test_declared_keys_come_first_and_only_where_supported(spark):
    tables = {
        "orders": make(spark, [(i, i) for i in range(5)], "id int, user_id int"),
        "users": make(spark, [(i,) for i in range(5)], "id int"),
    }
    profile = profile_tables(tables)
    declared = make(
        spark,
        [("orders", "user_id", "users", "id")] * 2,
        "from_table string, from_column string, to_table string, to_column string",
    )
    found = infer_relations(profile, declared).collect()
    assert [(r["confidence"], r["evidence"], r["is_declared"]) for r in found] == [(1.0, ["declared_fk"], True)]
    inferred = infer_relations(profile, declared, catalog.FILES).collect()
    assert [r["is_declared"] for r in inferred] == [False]
    assert relationship_map(infer_relations(profile, declared)).first()["confidence"] == "1.00"


def test_composite_keys_match_by_position(spark):
    usage = "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int"
    constraints = make(
        spark,
        [("fk", "public", "line", "FOREIGN KEY"), ("fk", "other", "line", "FOREIGN KEY")],
        "constraint_name string, table_schema string, table_name string, constraint_type string",
    )
    source = make(spark, [("fk", "public", "line", c, i) for i, c in enumerate("ab")], usage)
    target = make(spark, [("fk", "public", "head", c, i) for i, c in enumerate("xy")], usage)
    found = catalog.declared_keys_ansi(constraints, source, target).collect()
    assert sorted((r["from_column"], r["to_column"]) for r in found) == [("a", "x"), ("b", "y")]
    crossed = catalog.declared_keys_ansi(
        constraints, source.drop("ordinal_position"), target.drop("ordinal_position")
    )
    assert crossed.count() == 4


def test_orphans_with_a_hot_key(spark):
    child = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN NULL ELSE id END AS fk")
    parent = spark.range(1000).selectExpr("id AS pk").where("pk <> 7")
    got = orphan_counts(child, ["fk"], parent, ["pk"]).first()
    data = [r["fk"] for r in child.collect() if r["fk"] is not None]
    lost = [k for k in data if k >= 1000 or k == 7]
    assert tuple(got) == (len(data), len(lost), len(set(lost)))
    assert orphan_rows(child, ["fk"], parent, ["pk"]).count() == len(lost)


@pytest.mark.parametrize("rows_", [[], [(None,)]])
def test_orphans_of_nothing(spark, rows_):
    child = make(spark, rows_, "fk int")
    assert tuple(orphan_counts(child, ["fk"], make(spark, [(1,)], "pk int"), ["pk"]).first()) == (0, 0, 0)
