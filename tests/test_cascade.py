"""A batch through all rules against a recount of everything, in plain Python."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, same
from tradeledger import schema
from tradeledger.operators import cascade, changes
from tradeledger.plans import registered
from tradeledger.sources import conform, sinks
from tradeledger.sources.tables import Tables

CHILDREN = {"order_details": ("orders", "order_id"), "special_details": ("special_orders", "order_id"), "stock_details": ("stocks", "stock_id"),
            "grass_details": ("grass", "grass_id"), "grass_costs": ("grass", "grass_id"), "stock_payments": ("stocks", "stock_id"),
            "special_payments": ("special_orders", "order_id")}
CENT = D("0.01")


def cents(x):
    return D(x).quantize(CENT, ROUND_HALF_UP)


def recounted(book):
    """The derived columns of a whole book, from its lines."""
    for name in ("order_details", "stock_details", "special_details", "grass_details"):
        for r in book[name].values():
            r["real_qty"] = cents(r["qty"] * r["content"])
            r["subtotal"] = cents(r["qty"] * (r["price"] - r.get("discount", 0)))
    for r in book["grass_costs"].values():
        r["subtotal"] = cents(r["qty"] * r["price"])
    of = lambda name, key, i, value: sum((r[value] for r in book[name].values() if r[key] == i), D(0))
    for i, r in book["orders"].items():
        r["total"] = of("order_details", "order_id", i, "subtotal")
        r["remain_payment"] = r["total"] - r["payment"]
    for i, r in book["special_orders"].items():
        r["total"], r["payments"] = of("special_details", "order_id", i, "subtotal"), of("special_payments", "order_id", i, "nominal")
        r["remain_payment"] = r["total"] - r["cash"] - r["payments"]
    for i, r in book["stocks"].items():
        r["total"], r["payments"] = of("stock_details", "stock_id", i, "subtotal"), of("stock_payments", "stock_id", i, "nominal")
        r["remain_payment"] = r["total"] - r["cash"] - r["payments"]
    for i, r in book["grass"].items():
        r["cost"], r["qty"] = of("grass_costs", "grass_id", i, "subtotal"), of("grass_details", "grass_id", i, "real_qty")
        r["total"] = of("grass_details", "grass_id", i, "subtotal") - r["cost"]
    for i, r in book["products"].items():
        moved = [sign * of(n, "product_id", i, "real_qty") for n, sign in (("stock_details", 1), ("grass_details", 1), ("order_details", -1), ("special_details", -1))]
        r["stock"] = r["first_stock"] + sum(moved)
    return book


def frames(spark, book):
    """Rows with enough room in every amount; the lengths of decimals are not what is tested."""
    made = {}
    for name, rows in book.items():
        shape = schema.read_schema(name)
        made[name] = spark.createDataFrame([tuple(r[f.name] for f in shape) for r in rows.values()], shape)
    return Tables({n: (lambda d=d: d) for n, d in made.items()})


def plain(book):
    strip = lambda v: v.normalize() + 0 if isinstance(v, D) else v
    skip = {"updated_at", "created_at"}
    return {n: sorted((i, sorted((k, str(strip(v))) for k, v in r.items() if k not in skip)) for i, r in rows.items()) for n, rows in book.items()}


def collected(t, names):
    return {n: {r["id"]: r.asDict() for r in getattr(t, n).collect()} for n in names}


def random_batch(rng, book):
    """Edits of every table, and the book with its own columns changed the same way."""
    after = {n: {i: dict(r) for i, r in rows.items()} for n, rows in book.items()}
    edits = {n: [] for n in book}
    fresh = iter(range(10_000, 20_000))
    heads = {}
    for parent in dict.fromkeys(p for p, _ in CHILDREN.values()):
        rows = after[parent]
        new = next(fresh)
        like = dict(rng.choice(list(book[parent].values())), id=new)
        edits[parent].append(("I", new, like))
        rows[new] = dict(like)
        gone = rng.choice(list(book[parent]))
        edits[parent].append(("D", gone, dict(like, id=gone)))
        del rows[gone]
        heads[parent] = (list(rows), gone)
    for name, (parent, key) in CHILDREN.items():
        live, gone = heads[parent]
        for i, r in list(book[name].items()):
            if r[key] == gone:
                if name != "grass_costs":                # these go by themselves
                    edits[name].append(("D", i, r))
                del after[name][i]
                continue
            kind = rng.random()
            changed = dict(r)
            if kind < 0.25:
                edits[name].append(("D", i, r))
                del after[name][i]
            elif kind < 0.7:
                if rng.random() < 0.5:
                    changed[key] = rng.choice(live)
                for n in ("qty", "nominal", "price"):
                    if n in r and rng.random() < 0.7:
                        changed[n] = cents(rng.randint(1, 900)) / 4
                if "product_id" in r and rng.random() < 0.5:
                    changed["product_id"] = rng.choice(list(book["products"]))
                edits[name].append(("U", i, changed))
                after[name][i] = changed
        for _ in range(rng.randint(1, 4)):
            new = next(fresh)
            row = dict(rng.choice(list(book[name].values())), id=new)
            row[key] = rng.choice(live)
            edits[name].append(("I", new, row))
            after[name][new] = row
        edits[name].append(("U", 999_999, row))          # no such row
        taken = next((i for i in book[name] if all(e[1] != i for e in edits[name])), None)
        if taken is not None:
            edits[name].append(("I", taken, dict(row, id=taken)))
    for i in rng.sample(list(book["products"]), 3):
        row = dict(book["products"][i], first_stock=cents(rng.randint(0, 50)), price=cents(rng.randint(100, 900)))
        edits["products"].append(("U", i, row))
        after["products"][i] = row
        for u in after["units"].values():
            if u["product_id"] == i and row["price"] != book["products"][i]["price"]:
                base = row["price"] * u["content"]
                u["buy_price"], u["price"] = cents(base), cents(base + base * u["margin"])
    return edits, after


@pytest.mark.parametrize("seed_number", [1, 2, 3])
def test_a_batch_equals_a_recount(spark, seed, seed_number):
    rng = random.Random(seed_number)
    names = [*CHILDREN, "orders", "special_orders", "stocks", "grass", "products", "units"]
    book = collected(seed, [*names, "payments", "customers", "kasbons", "lunas"])
    order = next(iter(book["special_orders"].values()))
    book["special_payments"] = {i: {"customer_id": order["customer_id"], "order_id": order["id"], "id": i, "descriptions": None, "payment_at": order["created_at"],
                                    "nominal": D(i - 9500), "pay_num": "P", "lunas_id": 0} for i in (9501, 9502)}
    rest = {n: book.pop(n) for n in ("payments", "customers", "kasbons", "lunas")}
    for rows in book.values():
        for r in rows.values():
            r.update({k: v.replace(microsecond=0) for k, v in r.items() if hasattr(v, "microsecond")})
    recounted(book)
    edits, after = random_batch(rng, book)
    want = recounted(after)
    asked = {}
    for name, rows in edits.items():
        if rows:
            shape = schema.read_schema(name)
            asked[name] = spark.createDataFrame([(op, i, *[r.get(f.name) for f in shape if f.name != "id"]) for op, i, r in rows],
                                                "op string, id bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape if f.name != "id"))
    batch = cascade.apply_change_set(frames(spark, book | rest), asked, F.col("id") + 500_000)
    got = collected(batch.tables, names)
    assert plain(got) == plain(want)
    # Change sets are exact: rows before them are the old table's, rows after them the new one's.
    for name in ("orders", "products", "order_details"):
        for r in batch.changes[name].collect():
            assert (r.old.asDict() if r.old else None) == (collected(frames(spark, book | rest), [name])[name].get(r.id)) if r.old else r.op == "I"
            assert (r.new is None) == (r.op == "D")
    # Shares of touched purchases are paid, those of deleted ones taken back.
    paid = {r.ref_id: r.total for r in batch.tables.payments.where("ref_id <> 0").collect()}
    touched = {r.id: r.op for r in batch.changes["grass"].collect()}
    for i, op in touched.items():
        share = want["grass"][i]["total_div"] if op != "D" else D(0)
        assert paid.get(i, D(0)) == share


def test_batches_of_nothing_and_of_settlements(spark, seed):
    assert cascade.apply_change_set(seed, {}, F.col("id")).changes == {}
    with pytest.raises(ValueError):
        cascade.apply_change_set(seed, {"nothing": seed.orders}, F.col("id"))
    customer = seed.orders.where("lunas_id = 0").first()["customer_id"]
    new = spark.createDataFrame([("I", 9000, customer, D("12.50"))], "op string, id bigint, customer_id bigint, remain_payment decimal(12,2)")
    after = cascade.apply_change_set(seed, {"lunas": new}, F.col("id") + 1).tables
    assert after.orders.where(f"customer_id = {customer} AND lunas_id = 0").count() == 0
    carried = after.kasbons.where("ref_lunas_id = 9000").collect()
    assert [(r.id, r.total, r.lunas_id) for r in carried] == [(9001, D("12.50"), 0)]
    gone = spark.createDataFrame([("D", 9000)], "op string, id bigint")
    back = cascade.apply_change_set(after, {"lunas": gone}, F.col("id") + 1).tables
    assert sorted(map(tuple, back.orders.collect())) == sorted(map(tuple, seed.orders.collect())) and back.lunas.count() == seed.lunas.count()


def test_lines_are_numbered_once_and_lie_by_document(spark):
    t = conform.load(spark, SMALL)
    assert t.order_details.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    held = t.with_staged_lines()
    for name in ("order_details", "special_details", "grass_details", "stock_details", "grass_costs"):
        assert not any("lineitem" in file for file in getattr(held, name).inputFiles())
        assert same(getattr(held, name), getattr(t, name)) > 0


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """A book of more rows than may be sent to every task, in small files."""
    def table(name):
        value = {"string": F.lit("x"), "boolean": F.lit(False), "timestamp": F.lit("2024-01-01"), "timestamp_ntz": F.lit("2024-01-01")}
        columns = [(F.col("id") if f.name in ("id", "product_id", "order_id") else value.get(f.dataType.simpleString(), F.lit(1))).cast(f.dataType).alias(f.name) for f in schema.read_schema(name)]
        spark.range(cascade.SENT + 10_000).select(*columns).write.parquet(str(tmp_path / name))
        return spark.read.schema(schema.read_schema(name)).parquet(str(tmp_path / name))
    made = {n: spark.createDataFrame([], schema.read_schema(n)) for n in schema.DDL}
    made |= {n: table(n) for n in ("orders", "order_details", "products", "units")}
    return Tables({n: (lambda d=d: d) for n, d in made.items()})


@pytest.fixture
def plans(monkeypatch):
    """The plan of each change set that is written."""
    seen = {}

    def spy(df, name):
        seen[name] = planned(df)
        return sinks.staged(df, name)
    monkeypatch.setattr(cascade, "staged", spy)
    return seen


def edited(t, tmp_path, most):
    """Products get dearer, lines get one piece more."""
    spark, made = t.products.sparkSession, {}
    for name, column in (("products", "price"), ("order_details", "qty")):
        rows = getattr(t, name).where(F.col("id") < most).select(F.lit("U").alias("op"), "id", (F.col(column) + 1).alias(column))
        rows.write.parquet(str(tmp_path / f"edits-{name}"))
        made[name] = spark.read.parquet(str(tmp_path / f"edits-{name}"))
    return made


def test_no_table_goes_through_the_driver_because_its_files_are_small(spark, stored, plans, tmp_path):
    n = stored.products.count()
    after = cascade.apply_change_set(stored, edited(stored, tmp_path, n), F.col("id")).tables
    names = ["orders", "order_details", "products", "units"]
    assert set(plans) == {f"changes-{name}" for name in names}
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
    assert [name for name in names if "Broadcast" in planned(getattr(after, name))] == []
    assert (n, n) == (after.products.where("price = 2 AND stock = 0").count(), after.units.where("price = 4 AND buy_price = 2").count())
    assert (n, 0) == (after.orders.where("total = 0").count(), after.order_details.where("qty <> 2").count())


def test_few_changes_meet_large_tables_where_these_lie(spark, stored, plans, tmp_path):
    after = cascade.apply_change_set(stored, edited(stored, tmp_path, 3), F.col("id")).tables
    assert "Inner, BuildRight" in plans["changes-orders"]
    assert not any("BuildLeft" in plan for plan in plans.values())
    for name in ("orders", "order_details", "products", "units"):
        assert "LeftAnti, BuildRight" in planned(getattr(after, name))
        assert getattr(after, name).count() == getattr(stored, name).count()
    assert (3, 3) == (after.products.where("price = 2 AND stock = 0").count(), after.orders.where("total = 0").count())


def test_tables_before_a_batch_meet_by_shuffles(spark, stored, tmp_path):
    t = conform.load(spark, SMALL)
    before = registered._before_batch(t)
    for name in ("orders", "special_orders", "stocks", "grass", "products"):
        assert re.search(r"\w+Join", planned(getattr(before, name)))[0] == "SortMergeJoin"
    for name in ("special_payments", "stock_payments"):
        assert "Broadcast" not in planned(getattr(t, name))
    assert "Broadcast" not in planned(changes.change_set(stored.products, edited(stored, tmp_path, 3)["products"], "id"))
