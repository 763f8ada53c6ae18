"""Large parties are cut into chunks; results must not change."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, same
from tradeledger.operators import settle, shares
from tradeledger.operators.cuts import HOT_ROWS, with_chunk
from tradeledger.operators.running import running, with_chunks
from tradeledger.plans import ledgers
from tradeledger.sources import conform

LEDGERS = [ledgers.customer_line_ledger, ledgers.special_line_ledger, ledgers.customer_doc_ledger,
           ledgers.special_doc_ledger, ledgers.supplier_ledger, ledgers.product_stock_card]
PARTY = {ledgers.supplier_ledger: "supplier_id", ledgers.product_stock_card: "product_id"}


def text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def jobs(spark):
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)


@pytest.mark.parametrize("ledger", LEDGERS, ids=lambda f: f.__name__)
def test_cut_ledger_equals_plain(spark, ledger):
    t = conform.load(spark, SMALL)
    assert same(ledger(t), ledger(t, hot_rows=5)) > 0


@pytest.mark.parametrize("ledger", LEDGERS, ids=lambda f: f.__name__)
def test_building_a_ledger_runs_nothing_and_filters_reach_every_scan(spark, ledger):
    before = jobs(spark)
    t = conform.load(spark, SMALL)
    party = PARTY.get(ledger, "customer_id")
    plan = text(ledger(t).where(f"{party} = 2"))
    assert jobs(spark) == before
    # Every window and every count of rows per party sees one party only.
    counted = [line for line in plan.splitlines() if "Window [sum" in line or "collect_list" in line]
    assert len(counted) >= 3 and plan.count(" = 2)") >= len(counted)


@pytest.mark.parametrize("ledger", [ledgers.customer_line_ledger, ledgers.product_stock_card], ids=lambda f: f.__name__)
@pytest.mark.parametrize("hot_rows", [HOT_ROWS, 5])
def test_rows_move_once_to_their_party_and_samples_are_taken_once(spark, ledger, hot_rows):
    made = ledger(conform.load(spark, SMALL), hot_rows=hot_rows)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "Reused" not in line]
    assert "isFinalPlan=true" in plan and len(moved) == 1
    assert sum("partial_collect_list" in line for line in plan.splitlines()) <= 1


@pytest.mark.parametrize("hot_rows", [2, 40])
def test_one_party_holds_everything(spark, hot_rows):
    """One customer owns all documents, and one document most lines."""
    t = conform.load(spark, SMALL)
    owned = t.having(**{n: getattr(t, n).withColumn("customer_id", F.lit(7).cast("bigint"))
                        for n in ("orders", "kasbons", "payments", "grass", "special_orders", "special_payments")})
    one_doc = t.orders.agg(F.max("id")).first()[0]
    heavy = owned.having(order_details=t.order_details.withColumn(
        "order_id", F.when(F.col("qty") > 10, F.lit(one_doc)).otherwise(F.col("order_id"))))
    for ledger in (ledgers.customer_line_ledger, ledgers.customer_doc_ledger, ledgers.special_line_ledger):
        assert same(ledger(heavy), ledger(heavy, hot_rows=hot_rows)) > 0


def test_a_supplier_large_by_instalments(spark):
    t = conform.load(spark, SMALL)
    heavy = t.having(stocks=t.stocks.withColumn("supplier_id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.lit(2)).cast("bigint")))
    assert same(ledgers.supplier_ledger(heavy), ledgers.supplier_ledger(heavy, hot_rows=20)) > 0


SHAPES = {
    "many small documents": "SELECT 7L AS party, id div 10 AS doc, id % 10 AS line FROM range(9000)",
    "one large document": "SELECT 7L AS party, 3L AS doc, id AS line FROM range(9000)",
    "bunched ids": "SELECT 7L AS party, IF(id < 8990, id, id * 1000000000000) AS doc, 0L AS line FROM range(9000)",
    "dense beside sparse": "SELECT id % 2 AS party, IF(id % 2 = 0, id, id * 100000000000) AS doc, 0L AS line FROM range(9000)",
    "300 large parties": "SELECT id % 300 AS party, id AS doc, 0L AS line FROM range(60000)",
    "small parties": "SELECT id div 10 AS party, id AS doc, 0L AS line FROM range(3000)",
}


@pytest.mark.parametrize("shape", SHAPES, ids=str)
def test_chunks_are_even(spark, shape):
    """No chunk has more than three times ``hot_rows`` rows, and a party has few chunks more than it needs."""
    rows = spark.sql(SHAPES[shape])
    cut, _ = with_chunks(rows, ["party"], ["doc", "line"], hot_rows=100)
    sizes = cut.groupBy("party", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 300
    need = rows.groupBy("party").agg(F.ceil(F.count("*") / 100).alias("need"))
    assert sizes.groupBy("party").agg(F.count("*").alias("n")).join(need, "party").where("n > 3 * need").count() == 0
    asof = with_chunk(rows, ["party"], "doc", 100).groupBy("party", "doc").agg(F.count_distinct("_chunk").alias("n"))
    assert asof.where("n > 1").count() == 0
    args = (["party"], ["doc", "line"], {"total": F.col("doc").cast("decimal(28,2)"), "n": F.lit(1)})
    assert same(running(rows, *args), running(rows, *args, hot_rows=100)) == rows.count()


def test_chunks_grow_beyond_what_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tradeledger.operators.cuts.MOST_CHUNKS", 10)
    rows = spark.sql(SHAPES["many small documents"])
    cut, cuts = with_chunks(rows, ["party"], ["doc", "line"], hot_rows=100)
    assert 5 <= cut.select("_chunk").distinct().count() <= 12


def test_next_settlement_of_a_large_customer(spark):
    rows = spark.range(300).selectExpr("id", "id % 3 AS customer_id").where("id <> 7")
    plain = settle._with_next(rows, 1000)
    assert same(plain, settle._with_next(rows, 5)) == 299
    following = {r["id"]: r["_next"] for r in plain.collect()}
    assert following[4] == 10 and following[299] is None


def test_payments_without_purchase_stay_out_of_the_join(spark, seed):
    """Their common reference 0, or null, would be one hot join key; they are all kept."""
    analyzed = lambda df: df._jdf.queryExecution().analyzed().toString()
    shared = shares.profit_share_payments(seed.payments, seed.grass, seed.customers, F.col("id"))
    assert "Filter NOT (ref_id#" in analyzed(shared) and "Filter (coalesce(ref_id#" in analyzed(shared)
    amended = settle.amend_settlements(seed.kasbons, seed.lunas, F.col("id"))
    assert "Filter NOT (ref_lunas_id#" in analyzed(amended) and "Filter (coalesce(ref_lunas_id#" in analyzed(amended)


def test_null_references_are_kept(spark, seed):
    nulls = seed.payments.withColumn("ref_id", F.lit(None).cast("bigint"))
    kept = shares.profit_share_payments(nulls, seed.grass.limit(0), seed.customers, F.col("id"))
    assert kept.count() == nulls.count() > 0
    loose = seed.kasbons.withColumn("ref_lunas_id", F.lit(None).cast("bigint"))
    assert settle.amend_settlements(loose, seed.lunas.limit(0), F.col("id")).count() == loose.count() > 0
    revoked = settle.revoke_settlements(seed.having(kasbons=loose), seed.lunas)
    assert revoked.kasbons.count() == loose.count()


def test_lines_and_events_of_the_mapping_are_whole(spark):
    t = conform.load(spark, SMALL)
    lines = sum(getattr(t, n).count() for n in ("order_details", "special_details", "grass_details", "stock_details"))
    assert lines == t.raw("lineitem").count()
    paid = sum(getattr(t, n).count() for n in ("kasbons", "payments", "special_payments", "stock_payments"))
    assert paid == t.raw("events").count()
    assert t.grass_costs.count() == t.grass_details.count()
