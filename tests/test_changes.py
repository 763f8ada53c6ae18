"""Change application, and delta rollups against full recomputation."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import same
from tradeledger import schema
from tradeledger.operators import changes, derive, rollups

LINES = "id bigint, order_id bigint, product_id bigint, qty decimal(10,2), content decimal(8,2), price decimal(12,2), discount decimal(12,2)"


def line(rng, key):
    return (key, rng.randint(1, 6), rng.randint(1, 4), Decimal(rng.randint(1, 900)) / 100, Decimal(rng.choice([1, 10, 12])),
            Decimal(rng.randint(100, 99999)) / 100, Decimal(rng.randint(0, 99)) / 100)


def edited(spark, seed):
    """Random lines, random edits of them, and the lines afterwards."""
    rng = random.Random(seed)
    before = {k: line(rng, k) for k in range(1, 40)}
    after, edits = dict(before), []
    for k in list(before):
        choice = rng.random()
        if choice < 0.25:
            edits.append(("D", *before[k]))
            del after[k]
        elif choice < 0.6:
            after[k] = line(rng, k)     # other parent, product and amounts
            edits.append(("U", *after[k]))
    for k in range(100, 112):
        after[k] = line(rng, k)
        edits.append(("I", *after[k]))
    edits += [("D", *line(rng, 900)), ("U", *line(rng, 901)), ("I", *before[next(iter(set(before) & set(after)))])]
    make = lambda rows, shape=LINES: spark.createDataFrame(rows, shape)
    return (derive.order_lines(make(list(before.values()))), derive.order_lines(make(list(after.values()))),
            derive.order_lines(make(edits, "op string, " + LINES)))


@pytest.mark.parametrize("seed", range(4))
def test_delta_equals_full(spark, seed):
    before, after, edits = edited(spark, seed)
    parents = spark.range(1, 7)
    fields = ["id", "order_id", "product_id", "real_qty", "subtotal"]
    change = changes.change_set(before, edits.select("op", *fields), "id")
    stored = rollups.order_totals(parents, before)
    assert same(rollups.order_totals_delta(stored, change), rollups.order_totals(parents, after)) == 6

    products = spark.range(1, 5).withColumn("first_stock", F.lit(50).cast("decimal(12,2)"))
    empty = before.limit(0)
    book = lambda lines: type("Book", (), {
        "products": products, "order_details": lines, "special_details": empty,
        "stock_details": lines, "grass_details": empty})
    on_hand = rollups.stock_on_hand(book(before))
    # the same lines sold and received cancel out; sold only, they do not
    assert same(rollups.stock_on_hand_delta(on_hand, {"order_details": change, "stock_details": change}),
                rollups.stock_on_hand(book(after))) == 4
    sold = lambda lines: type("Book", (), {**vars(book(lines)), "stock_details": empty})
    assert same(rollups.stock_on_hand_delta(rollups.stock_on_hand(sold(before)), {"order_details": change}),
                rollups.stock_on_hand(sold(after))) == 4


@pytest.mark.parametrize("seed", [11, 12])
def test_purchase_and_payment_deltas(spark, seed):
    before, after, edits = edited(spark, seed)
    shape = lambda df: df.selectExpr("id", "order_id AS grass_id", "real_qty", "subtotal")
    parents = spark.range(1, 7)
    none = shape(before).limit(0)
    change = changes.change_set(shape(before), edits.selectExpr("op", "id", "order_id AS grass_id", "real_qty", "subtotal"), "id")
    stored = rollups.purchase_totals(parents, shape(before), none)
    assert same(rollups.purchase_totals_delta(stored, change), rollups.purchase_totals(parents, shape(after), none)) == 6

    both = lambda costs: rollups.purchase_totals(parents, none, costs).join(rollups.purchase_costs(parents, costs), "id")
    assert same(rollups.purchase_costs_delta(both(shape(before)), change), both(shape(after))) == 6

    paid = lambda df, parent: df.selectExpr("id", f"order_id AS {parent}", "subtotal AS nominal")
    for parent, full, delta in (("stock_id", rollups.stock_payments, rollups.stock_payments_delta),
                                ("order_id", rollups.special_payments, rollups.special_payments_delta)):
        moved = changes.change_set(paid(before, parent),
                                   edits.selectExpr("op", "id", f"order_id AS {parent}", "subtotal AS nominal"), "id")
        assert same(delta(full(parents, paid(before, parent)), moved), full(parents, paid(after, parent))) == 6


def test_insert_then_delete_is_identity(spark, seed):
    new = spark.createDataFrame([(900, "new one", "kg", 1), (901, "new two", "kg", 2)],
                                "id bigint, name string, unit string, category_id bigint")
    grown = changes.apply_inserts(seed.products, new, "id", schema.DEFAULTS["products"])
    added = grown.where("id = 900").first()
    assert (added["price"], added["stock"], added["update_notif"], added["spec"]) == (0, 0, False, None)
    assert same(changes.apply_deletes(grown, new, "id"), seed.products) == 5
    assert {r["id"] for r in changes.deleted_ids(grown, new, "id").collect()} == {900, 901}


def test_inserts_with_taken_keys_are_rejected(spark, seed):
    new = seed.products.where("id = 7").withColumn("name", F.lit("again"))
    assert same(changes.apply_inserts(seed.products, new, "id"), seed.products) == 5
    assert changes.rejected_inserts(seed.products, new, "id").count() == 1
    assert changes.insert_products(seed.products, new)[1].count() == 0


def test_update_can_set_null(spark, seed):
    change = spark.createDataFrame([(7, None, Decimal("1.00"))], "id bigint, name string, price decimal(12,2)")
    row = changes.apply_updates(seed.products, change, "id").where("id = 7").first()
    assert (row["name"], row["price"], row["unit"]) == (None, Decimal("1.00"), "btl")
    assert [r["id"] for r in changes.updated_rows(seed.products, change, "id").collect()] == [7]


def test_default_unit(spark, seed):
    choice = spark.createDataFrame([(7, 2), (16, 999)], "product_id bigint, unit_id bigint")
    after = changes.set_default_units(seed.units, choice)
    assert {r["id"] for r in after.where("is_default").collect()} == {2, 20, 21}


def test_new_units_are_never_default(spark, seed):
    unit = spark.createDataFrame([(7, 77, "box", True)], "product_id bigint, id bigint, name string, is_default boolean")
    assert changes.insert_units(seed.units, unit).where("id = 77").first()["is_default"] is False


def test_opening_stock_and_prices(spark, seed):
    opened = spark.createDataFrame([(7, Decimal("100.00"))], "id bigint, first_stock decimal(12,2)")
    row = rollups.opening_stock_shift(seed.products, opened).where("id = 7").first()
    assert (row["first_stock"], row["stock"]) == (100, 89)
    price = spark.createDataFrame([(7, Decimal("10.01"))], "id bigint, price decimal(12,2)")
    got = {r["id"]: (r["buy_price"], r["price"]) for r in
           rollups.unit_price_refresh(seed.units, price).where("product_id = 7").collect()}
    assert got[25] == (Decimal("120.12"), Decimal("150.15"))
    assert got[1] == (Decimal("10.01"), Decimal("15.02"))      # 15.015 rounds away from zero


def test_defaults_name_real_columns_and_now(spark, seed):
    for table, defaults in schema.DEFAULTS.items():
        assert set(defaults) <= {f.name for f in schema.declared(table)}
    new = spark.createDataFrame([(9, "later")], "id bigint, name string")
    row = changes.apply_inserts(seed.categories, new, "id", schema.DEFAULTS["categories"]).where("id = 9").first()
    assert row["name"] == "later" and row["created_at"] is not None and row["created_at"] == row["updated_at"]
