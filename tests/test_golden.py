"""Reports on the small fixed book against values worked out by hand."""

from decimal import Decimal

import pytest

from tradeledger.operators import catalog, derive, quality, rollups
from tradeledger.plans import balances, ledgers, profit


def rows(df, *columns):
    def plain(v):
        return int(v) if isinstance(v, Decimal) and v == v.to_integral_value() else v
    return [tuple(plain(r[c]) for c in columns) for r in df.collect()]


OPEN = "customer_id = {} AND lunas_id = 0"


def test_customer_balance(seed):
    got = rows(balances.customer_balance(seed).where(OPEN.format(2)).orderBy("id"), "id", "debt", "cred", "balance")
    assert got == [(1, 534000, 85000, 449000), (2, 1625000, 0, 2074000),
                   (3, 0, 3977500, -1903500), (4, 0, 1225000, -3128500)]


def test_customer_doc_ledger(seed):
    got = rows(ledgers.customer_doc_ledger(seed).where(OPEN.format(2)).orderBy("id"), "id", "debt", "cred", "balance")
    assert got == [
        (31, 1500000, 0, 1500000), (32, 300000, 30000, 1770000), (33, 0, 25000, 1745000), (37, 25000, 0, 1770000),
        (49, 54000, 0, 1824000), (125, 0, 500000, 1324000), (162, 180000, 55000, 1449000), (163, 100000, 0, 1549000),
        (165, 0, 700000, 849000), (206, 0, 3977500, -3128500)]


def test_customer_line_ledger(seed):
    got = rows(ledgers.customer_line_ledger(seed).where(OPEN.format(2)).orderBy("row_no"),
               "row_no", "doc_id", "branch", "debt", "cred", "balance")
    assert got == [
        (1, 31, 1, 1500000, 0, 1500000), (2, 32, 2, 300000, 0, 1800000), (3, 32, 3, 0, 30000, 1770000),
        (4, 33, 5, 0, 25000, 1745000), (5, 37, 1, 25000, 0, 1770000), (6, 49, 2, 39000, 0, 1809000),
        (7, 49, 2, 15000, 0, 1824000), (8, 125, 5, 0, 500000, 1324000), (9, 162, 2, 30000, 0, 1354000),
        (10, 162, 2, 150000, 0, 1504000), (11, 162, 3, 0, 55000, 1449000), (12, 163, 1, 100000, 0, 1549000),
        (13, 165, 5, 0, 700000, 849000), (14, 206, 4, 0, 3977500, -3128500)]


def test_texts(seed):
    got = {r["branch"]: r["title"] for r in ledgers.customer_line_ledger(seed).where(OPEN.format(2)).collect()
           if r["doc_id"] in (31, 162, 206, 165)}
    assert got == {1: "Kasbon #31", 2: "Piutang Barang #162", 3: "DP Piutang Barang: #162",
                   4: "Pembelian: #206", 5: "Angsuran: #165"}
    special = ledgers.special_doc_ledger(seed).collect()[0]
    assert special["descriptions"] == "ORDER ID#: 207"


def test_stock_card(seed):
    card = ledgers.product_stock_card(seed)
    got = rows(card.where("product_id = 7").orderBy("id"), "id", "real_qty", "balance")
    assert got == [(0, 90, 90), (91, 10, 100), (92, 4, 104), (96, 3, 107), (112, -1, 106), (157, -1, 105),
                   (160, -2, 103), (167, -10, 93), (169, -12, 81)]
    got = rows(card.where("product_id = 16").orderBy("id"), "id", "real_qty", "balance")
    assert got == [(0, 0, 0), (193, -500, -500), (225, 150, -350)]
    first = card.where("id = 91").first()
    assert (first["trx_date"], first["faktur"], first["name"], first["debt"]) == (
        "22-11-2021", "stock-12", "supplier-5", Decimal("1.00"))


@pytest.mark.parametrize("supplier, expected", [
    (2, [(1, 700000, 2250000, 1550000), (2, 1300000, 0, 250000)]),
    (4, [(1, 5000, 100000, 95000), (2, 95000, 0, 0)])])
def test_supplier_balance(seed, supplier, expected):
    got = rows(balances.supplier_balance(seed).where(f"supplier_id = {supplier}").orderBy("id"),
               "id", "cred", "debt", "balance")
    assert got == expected


def test_supplier_ledger(seed):
    ledger = ledgers.supplier_ledger(seed)
    assert rows(ledger.where("supplier_id = 2").orderBy("id"), "id", "debt", "cred", "balance") == [
        (4, 2250000, 700000, 1550000), (26, 0, 50000, 1500000), (32, 0, 1250000, 250000)]
    assert rows(ledger.where("supplier_id = 4").orderBy("id"), "id", "debt", "cred", "balance") == [
        (11, 100000, 5000, 95000), (23, 0, 50000, 45000), (24, 0, 35000, 10000), (27, 0, 10000, 0)]


def test_special(seed):
    assert rows(balances.special_balance(seed).where(OPEN.format(3)).orderBy("id"), "id", "debt", "cred", "balance") == [
        (1, 1525000, 0, 1525000), (2, 0, 0, 1525000)]
    # a customer without wholesale orders still has both rows
    assert rows(balances.special_balance(seed).where(OPEN.format(1)).orderBy("id"), "id", "debt", "cred", "balance") == [
        (1, 0, 0, 0), (2, 0, 0, 0)]
    assert rows(ledgers.special_line_ledger(seed).where(OPEN.format(3)).orderBy("line_id"),
                "doc_id", "qty", "price", "debt", "balance") == [
        (207, 100, 5500, 550000, 550000), (207, 500, 1950, 975000, 1525000)]


def test_profit_lines(seed):
    got = rows(profit.profit_lines(seed, "2021-12-06", "2021-12-16T00:00").orderBy("id", "line_id"),
               "id", "line_id", "buy_price", "sale_price", "discount", "profit", "qty", "subtotal")
    assert got == [
        (162, 160, 10000, 15000, 0, 5000, 2, 10000), (162, 169, 120000, 150000, 0, 30000, 1, 30000),
        (207, 192, 3500, 5500, 0, 2000, 100, 200000), (207, 193, 1500, 1950, 0, 450, 500, 225000)]
    retail = profit.profit_lines(seed, "2021-12-06", "2021-12-16", profit.RETAIL)
    assert {r["id"] for r in retail.collect()} == {162}
    wholesale = profit.profit_lines(seed, "2021-12-06", "2021-12-16", profit.WHOLESALE)
    assert {r["id"] for r in wholesale.collect()} == {207}


def test_profit_by_order(seed):
    names = ("id", "order_type", "buy_price", "sale_price", "subtotal", "discount", "profit")
    expected = [(46, 0, 290000, 379000, 89000, 0, 89000), (49, 0, 40000, 54000, 14000, 0, 14000)]
    assert rows(profit.profit_by_order(seed, "2021-11-28").orderBy("id"), *names) == expected
    everything = profit.profit_by_order(seed)
    assert rows(everything.where("order_day = '2021-11-28'").orderBy("id"), *names) == expected


def test_profit_by_period(seed):
    names = ("id", "order_date", "buy_price", "sale_price", "subtotal", "discount", "profit")
    assert rows(profit.profit_by_day(seed, 2021, 12), *names) == [
        (6, "2021-12-06", 140000, 180000, 40000, 0, 40000), (16, "2021-12-16", 1100000, 1525000, 425000, 0, 425000)]
    names = ("id", "buy_price", "sale_price", "subtotal", "discount", "profit")
    months = [(11, 680000, 888000, 208000, 55000, 153000), (12, 1240000, 1705000, 465000, 0, 465000)]
    assert rows(profit.profit_by_month(seed, 2021), *names) == months
    assert rows(profit.profit_by_month(seed, 2021, 12), *names) == months[1:]
    assert rows(profit.profit_by_month(seed), *names) == months


def test_profit_of_order(spark, seed):
    wanted = spark.createDataFrame([(49,)], "id bigint")
    got = rows(profit.profit_of_order(seed, 0, wanted).orderBy("id"),
               "id", "buy_price", "sale_price", "discount", "qty", "profit")
    assert got == [(115, 30000, 39000, 0, 1, 9000), (157, 10000, 15000, 0, 1, 5000)]


def test_stock_drift(seed):
    got = rows(quality.drift(seed.products, "stock", rollups.stock_on_hand(seed)).orderBy("id"),
               "id", "stored", "recomputed", "difference")
    assert got == [(1, 143, 153, -10), (7, 79, 81, -2), (15, 111, 121, -10), (16, -1850, -350, -1500), (23, 650, 650, 0)]


def test_document_totals_agree(seed):
    pairs = [
        (seed.orders, "total", rollups.order_totals(seed.orders, seed.order_details)),
        (seed.special_orders, "total", rollups.special_totals(seed.special_orders, seed.special_details)),
        (seed.stocks, "total", rollups.stock_totals(seed.stocks, seed.stock_details)),
        (seed.stocks, "payments", rollups.stock_payments(seed.stocks, seed.stock_payments)),
        (seed.special_orders, "payments", rollups.special_payments(seed.special_orders, seed.special_payments)),
        (seed.grass, "total", rollups.purchase_totals(seed.grass, seed.grass_details, seed.grass_costs)),
        (seed.grass, "qty", rollups.purchase_totals(seed.grass, seed.grass_details, seed.grass_costs)),
        (seed.grass, "cost", rollups.purchase_costs(seed.grass, seed.grass_costs)),
        (seed.orders, "remain_payment", derive.order_remainder(seed.orders)),
        (seed.stocks, "remain_payment", derive.stock_remainder(seed.stocks)),
        (seed.special_orders, "remain_payment", derive.special_remainder(seed.special_orders)),
    ]
    for stored, column, again in pairs:
        drift = quality.drift(stored, column, again)
        assert drift.count() == stored.count()
        assert drift.where("difference <> 0").count() == 0, column


def test_line_amounts_agree(seed):
    for lines, rule in [(seed.order_details, derive.order_lines), (seed.stock_details, derive.stock_lines),
                        (seed.special_details, derive.special_lines), (seed.grass_details, derive.purchase_lines),
                        (seed.grass_costs, derive.purchase_costs)]:
        names = [n for n in ("real_qty", "subtotal") if n in lines.columns]
        kept = lines.select("id", *names)
        again = rule(lines).select("id", *[n for n in names])
        assert kept.exceptAll(again.select(*[again[n].cast(t).alias(n) for n, t in kept.dtypes])).count() == 0


def test_unit_prices(seed):
    again = rollups.unit_price_refresh(seed.units, seed.products.select("id", "price")).select(
        "id", again_price := "price", "buy_price")
    both = seed.units.selectExpr("id", "price AS old", "buy_price AS old_buy").join(again, "id")
    assert both.where("old_buy <> buy_price").count() == 0
    off = both.where(f"old <> {again_price}").selectExpr("id", "old - price AS gap").collect()
    assert [(r["id"], r["gap"]) for r in off] == [(27, Decimal("0.10"))]


def test_default_units(seed):
    counts = {r["product_id"]: r["n"] for r in
              seed.units.selectExpr("product_id", "CAST(is_default AS int) AS d").groupBy("product_id")
              .agg({"d": "sum"}).withColumnRenamed("sum(d)", "n").collect()}
    assert counts == {1: 1, 7: 1, 15: 1, 16: 1, 23: 0}


def test_nested_lists(seed):
    listed = {r["id"]: [p["id"] for p in r["products"]] for r in
              catalog.category_products(seed.categories, seed.products).collect()}
    assert listed == {1: [1, 7, 15], 2: [16, 23]}
    cut = catalog.with_children(seed.categories, seed.products, "category_id", "products", span=2).collect()
    assert sorted((r["id"], r["part"], [p["id"] for p in r["products"]]) for r in cut) == [
        (1, 0, [1]), (1, 3, [7]), (1, 7, [15]), (2, 8, [16]), (2, 11, [23])]
