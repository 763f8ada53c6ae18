"""Settlements and profit shares against a row-by-row account of the rules."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import same
from tradeledger.operators import settle, shares

DAY = datetime(2022, 1, 1)
ITEMS = "id bigint, customer_id bigint, lunas_id bigint"
ADVANCES = "id bigint, customer_id bigint, descriptions string, kasbon_date timestamp, jatuh_tempo timestamp, total decimal(12,2), lunas_id bigint, ref_lunas_id bigint"
LUNAS = "id bigint, customer_id bigint, remain_payment decimal(12,2), created_at timestamp"
PLAIN = [n for n in settle.STAMPED if n != "kasbons"]


def new_id():
    return F.col("id") + 100_000


def book(rng):
    """Items by table, and advances, as dictionaries by id."""
    items = {n: {k: [k, rng.randint(1, 4), rng.choice([0, 0, 1])] for k in range(i * 100, i * 100 + 12)}
             for i, n in enumerate(PLAIN)}
    kasbons = {k: [k, rng.randint(1, 4), "advance", DAY, DAY + timedelta(days=7), Decimal(k), rng.choice([0, 0, 1]), 0]
               for k in range(900, 910)}
    return items, kasbons


def settled_by_hand(items, kasbons, settlements):
    for key, customer, remain, day in sorted(settlements):
        for table in items.values():
            for row in table.values():
                if row[1] == customer and row[2] == 0:
                    row[2] = key
        for row in kasbons.values():
            if row[1] == customer and row[6] == 0:
                row[6] = key
        if remain > 0:
            kasbons[key + 100_000] = [key + 100_000, customer, f"Saldo piutang pelunasan ID #{key}", day,
                                      day + timedelta(days=7), remain, 0, key]


def tables(spark, items, kasbons):
    from tradeledger.sources.tables import Tables
    made = {n: spark.createDataFrame([tuple(r) for r in rows.values()], ITEMS) for n, rows in items.items()}
    made["kasbons"] = spark.createDataFrame([tuple(r) for r in kasbons.values()], ADVANCES)
    return Tables({n: (lambda df=df: df) for n, df in made.items()})


def settlements(rng):
    return [(10 + i, rng.randint(1, 3), Decimal(rng.choice([0, 0, 25, 300])), DAY + timedelta(days=i)) for i in range(6)]


@pytest.mark.parametrize("seed", range(3))
def test_apply_amend_revoke(spark, seed):
    rng = random.Random(seed)
    items, kasbons = book(rng)
    t = tables(spark, items, kasbons)
    done = settlements(rng)
    batch = spark.createDataFrame(done, LUNAS)
    after = settle.apply_settlements(t, batch, new_id())
    settled_by_hand(items, kasbons, done)
    expected = tables(spark, items, kasbons)
    for name in settle.STAMPED:
        same(getattr(after, name), getattr(expected, name))

    # amend: half of them get another remainder
    changed = [(k, cust, Decimal(rng.choice([0, 70])), day + timedelta(days=30)) for k, cust, _, day in done[::2]]
    for key, customer, remain, day in changed:
        held = [k for k, row in kasbons.items() if row[7] == key]
        if remain <= 0:
            for k in held:
                del kasbons[k]
        elif held:
            for k in held:
                kasbons[k][3:6] = [day, day + timedelta(days=7), remain]
        else:
            kasbons[key + 100_000] = [key + 100_000, customer, f"Saldo piutang pelunasan ID #{key}", day,
                                      day + timedelta(days=7), remain, 0, key]
    amended = settle.amend_settlements(after.kasbons, spark.createDataFrame(changed, LUNAS), new_id())
    same(amended, tables(spark, items, kasbons).kasbons)

    # revoke: some are taken back
    gone = done[1::3]
    for key, customer, *_ in gone:
        for table in items.values():
            for row in table.values():
                if row[1] == customer and row[2] == key:
                    row[2] = 0
        for k in [k for k, row in kasbons.items() if row[7] == key and row[1] == customer]:
            del kasbons[k]
        for row in kasbons.values():
            if row[1] == customer and row[6] == key:
                row[6] = 0
    back = settle.revoke_settlements(after.having(kasbons=amended), spark.createDataFrame(gone, LUNAS))
    expected = tables(spark, items, kasbons)
    for name in settle.STAMPED:
        same(getattr(back, name), getattr(expected, name))


def test_revoke_undoes_apply(spark):
    rng = random.Random(5)
    items, kasbons = book(rng)
    t = tables(spark, items, kasbons)
    batch = spark.createDataFrame([(50, 2, Decimal(10), DAY)], LUNAS)
    back = settle.revoke_settlements(settle.apply_settlements(t, batch, new_id()), batch)
    for name in settle.STAMPED:
        same(getattr(back, name), getattr(t, name))


PAYMENTS = "id bigint, customer_id bigint, descriptions string, ref_id bigint, payment_date timestamp, total decimal(12,2), lunas_id bigint"
GRASS = "id bigint, customer_id bigint, partner_id bigint, order_date timestamp, qty decimal(10,2), total_div decimal(12,2)"


def test_profit_share(spark, seed):
    payments = spark.createDataFrame([
        (1, 2, "instalment", 0, DAY, Decimal(5), 0),
        (2, 3, "old share", 70, DAY, Decimal(9), 4),       # changes, keeps id and settlement
        (3, 3, "old share", 71, DAY, Decimal(9), 0),       # share withdrawn
        (4, 3, "old share", 72, DAY, Decimal(9), 0),       # purchase deleted
        (5, 3, "old share", 73, DAY, Decimal(9), 0),       # purchase untouched
    ], PAYMENTS)
    purchases = spark.createDataFrame([
        (70, 1, 4, DAY, Decimal("12345.00"), Decimal("20.00")), (71, 1, 4, DAY, Decimal(1), Decimal(0)),
        (74, 2, 3, DAY, Decimal("750.00"), Decimal("30.00")), (75, 2, 3, DAY, Decimal(1), Decimal(0)),
    ], GRASS)
    deleted = spark.createDataFrame([(72,)], "id bigint")
    after = {r["id"]: r for r in shares.profit_share_payments(
        payments, purchases, seed.customers, F.col("id") + 1000, deleted).collect()}
    assert set(after) == {1, 2, 5, 1074}
    assert (after[2]["customer_id"], after[2]["total"], after[2]["lunas_id"]) == (4, 20, 4)
    assert after[2]["descriptions"] == "Bagi hasil dengan customer-1 (12,345 kg )"
    assert (after[1074]["customer_id"], after[1074]["ref_id"], after[1074]["total"], after[1074]["lunas_id"]) == (3, 74, 30, 0)
