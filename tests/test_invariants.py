"""Statements that hold between reports."""

from pyspark.sql import functions as F

from conftest import SMALL
from tradeledger.operators import rollups
from tradeledger.plans import balances, ledgers
from tradeledger.sources import conform

PARTY = ["customer_id", "lunas_id"]


def last(df, parts, by):
    return df.groupBy(*parts).agg(F.max_by("balance", by).alias("balance"))


def test_customer_balances_agree(spark):
    t = conform.load(spark, SMALL)
    summary = last(balances.customer_balance(t), PARTY, "id").withColumnRenamed("balance", "a")
    documents = last(ledgers.customer_doc_ledger(t), PARTY, "id").withColumnRenamed("balance", "b")
    lines = ledgers.customer_line_ledger(t)
    by_line = last(lines, PARTY, "row_no").withColumnRenamed("balance", "c")
    bought = lines.where("branch = 4").groupBy(*PARTY).count()
    # a party whose documents are all worth nothing has no summary row
    both = documents.join(summary, PARTY, "left")
    assert both.where("coalesce(a, 0) <> b").count() == 0
    gap = documents.join(by_line, PARTY, "left").join(bought, PARTY, "left").where(
        "abs(b - coalesce(c, 0)) > 0.01 * coalesce(count, 0)")
    assert gap.count() == 0


def test_supplier_and_special_balances_agree(spark):
    t = conform.load(spark, SMALL)
    a = last(balances.supplier_balance(t), ["supplier_id"], "id").withColumnRenamed("balance", "a")
    b = last(ledgers.supplier_ledger(t), ["supplier_id"], "id")
    assert b.join(a, "supplier_id", "left").where("coalesce(a, 0) <> balance").count() == 0
    a = last(balances.special_balance(t), PARTY, "id").withColumnRenamed("balance", "a")
    documents = last(ledgers.special_doc_ledger(t), PARTY, "id")
    assert documents.join(a, PARTY, "left").where("coalesce(a, 0) <> balance").count() == 0


def test_stock_card_ends_at_stock_on_hand(spark):
    t = conform.load(spark, SMALL)
    card = last(ledgers.product_stock_card(t), ["product_id"], "id").withColumnRenamed("product_id", "id")
    both = rollups.stock_on_hand(t).join(card, "id", "left")
    assert both.where("stock <> balance OR balance IS NULL").count() == 0


def test_ids_never_meet(spark):
    t = conform.load(spark, SMALL)
    documents = [t.orders, t.special_orders, t.grass, t.stocks, t.kasbons, t.payments, t.special_payments, t.stock_payments]
    lines = [t.order_details, t.special_details, t.grass_details, t.stock_details]
    for group in (documents, lines):
        ids = group[0].select("id")
        for df in group[1:]:
            ids = ids.union(df.select("id"))
        assert ids.groupBy("id").count().where("count > 1").count() == 0


def test_a_receipt_has_the_lines_of_one_supplier(spark):
    t = conform.load(spark, SMALL)
    bought = "NOT l_returnflag <=> 'N' AND NOT l_returnflag <=> 'R' AND NOT l_linestatus <=> 'O'"
    lines = t.raw("lineitem").where(bought).groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    received = t.stock_details.join(t.stocks.selectExpr("id AS stock_id", "supplier_id", "stock_num"), "stock_id")
    here = received.selectExpr("CAST(split_part(stock_num, '-', 2) AS bigint) AS l_orderkey", "supplier_id AS l_suppkey").groupBy(
        "l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    assert here.exceptAll(lines).union(lines.exceptAll(here)).count() == 0
    orders, suppliers = t.raw("orders").count(), lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    assert t.stocks.count() == orders + suppliers.agg(F.sum(F.col("n") - 1)).first()[0]
    assert t.stock_payments.count() == t.supplier_instalments().count()


def test_receipts_move_their_lines_once(spark):
    t = conform.load(spark, SMALL)
    plan = t.receipts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(doc_id" not in plan
