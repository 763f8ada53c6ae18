"""Constraint jobs on rows that break them."""

from decimal import Decimal

from conftest import same
from tradeledger import schema
from tradeledger.operators import changes, quality


def with_row(seed, table, **values):
    """The book with one more row in ``table``; other columns copy an existing row."""
    base = getattr(seed, table)
    row = base.orderBy("id").limit(1)
    for name, value in values.items():
        row = row.withColumn(name, quality.F.lit(value).cast(base.schema[name].dataType))
    return seed.having(**{table: base.union(row.select(*base.columns))})


def test_clean_book(seed):
    assert quality.dup_keys(seed).where("n_dup_keys > 0").count() == 0
    assert quality.dup_keys(seed).count() == 19
    assert quality.dup_natural_keys(seed).count() == 0
    assert quality.orphans(seed).where("n_orphan_rows > 0").count() == 0
    assert quality.orphans(seed).count() == 25
    assert quality.bad_values(seed).where("n_null + n_too_long > 0").count() == 0
    assert quality.bad_customer_type(seed.customers).count() == 0


def test_duplicates(seed):
    twice = with_row(seed, "orders")
    got = quality.dup_keys(twice).where("n_dup_keys > 0").collect()
    assert [(r["table_name"], r["n_rows"], r["n_dup_keys"]) for r in got] == [("orders", 6, 1)]
    named = with_row(seed, "units", id=500)
    got = quality.dup_natural_keys(named).collect()
    assert [(r["table_name"], r["key_text"], r["n"]) for r in got] == [("units", "7|btl", 2)]


def test_orphans(seed):
    lost = with_row(seed, "order_details", id=999, order_id=12345)
    got = quality.orphans(lost).where("n_orphan_rows > 0").collect()
    assert [(r["reference"], r["n_missing_keys"], r["n_orphan_rows"]) for r in got] == [("order_details.order_id", 1, 1)]
    keys = quality.orphan_keys(lost.order_details, "order_id", lost.orders).collect()
    assert [(r["id"], r["n"]) for r in keys] == [(12345, 1)]


def test_values(seed):
    bad = with_row(seed, "products", id=999, name="x" * 51, unit=None)
    got = quality.bad_values(bad).where("n_null + n_too_long > 0").collect()
    assert sorted((r["column_name"], r["n_null"], r["n_too_long"]) for r in got) == [("name", 0, 1), ("unit", 1, 0)]
    odd = with_row(seed, "customers", id=999, name="odd", customer_type="other")
    assert [r["id"] for r in quality.bad_customer_type(odd.customers).collect()] == [999]
    kinds = {r["customer_type"]: r["valid"] for r in quality.customer_types(odd.customers).collect()}
    assert kinds == {"Bandeng": True, "Rumput Laut": True, "Pabrik": True, "other": False}


def test_deletes(spark, seed):
    wanted = spark.createDataFrame([(1,), (4,), (77,)], "id bigint")
    got = {(r["id"], r["used_by"], r["n_rows"]) for r in quality.blocked_deletes(seed, "customers", wanted).collect()}
    assert got == {(1, "orders.customer_id", 2), (1, "grass.customer_id", 1), (4, "kasbons.customer_id", 1)}
    # costs do not block their purchase, they go with it
    purchase = spark.createDataFrame([(206,)], "id bigint")
    assert {r["used_by"] for r in quality.blocked_deletes(seed, "grass", purchase).collect()} == {"grass_details.grass_id"}
    left = changes.apply_deletes(seed.grass, purchase, "id")
    assert quality.cascade_costs(seed.grass_costs, left).count() == 0
    assert same(quality.cascade_costs(seed.grass_costs, seed.grass), seed.grass_costs) == 2


def test_declared_schema():
    lengths = {f.name: f.dataType.length for f in schema.declared("products") if f.dataType.typeName() == "varchar"}
    assert lengths == {"name": 50, "spec": 50, "unit": 6}
    assert len(schema.DDL) == 19 and len(schema.FOREIGN_KEYS) == 25
    assert str(schema.read_schema("units")["margin"].dataType) == "DecimalType(5,4)"
    assert Decimal(0) == schema.DEFAULTS["products"]["price"]
