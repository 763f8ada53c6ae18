"""Streams end where the batch reports end, also after restarts and repeats."""

import shutil
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SMALL, same
from tradeledger.operators import rollups
from tradeledger.sources import conform
from tradeledger.streaming import live


def moves(t):
    return rollups.stock_moves(t).select(
        F.monotonically_increasing_id().alias("change_id"), F.lit(datetime(2024, 2, 1)).alias("changed_at"),
        "product_id", "moved")


def test_restart_continues_where_it_stopped(spark, tmp_path):
    feed, out, mark = (str(tmp_path / n) for n in ("feed", "out", "mark"))
    t = conform.load(spark, SMALL)
    rows = moves(t)
    totals = lambda: live.stock(live.read_feed(spark, feed, live.MOVES, files_per_batch=1))
    rows.where("product_id < 100").repartition(3).write.parquet(feed)
    live.keep(totals(), out, mark).awaitTermination()
    rows.where("product_id >= 50").repartition(2).write.mode("append").parquet(feed)
    live.keep(totals(), out, mark).awaitTermination()
    live.keep(totals(), out, mark).awaitTermination()      # nothing new
    expected = rows.where("product_id < 100").union(rows.where("product_id >= 50")).groupBy("product_id").agg(
        F.sum("moved").cast("decimal(28,2)").alias("moved"))
    assert same(live.latest(spark, out, "product_id", "moved"), expected) > 100


def test_repeated_changes_count_once(spark, tmp_path):
    feed, out, mark = (str(tmp_path / n) for n in ("feed", "out", "mark"))
    day = datetime(2024, 2, 1)
    rows = [(1, day, 7, Decimal(10), Decimal(0)), (2, day, 7, Decimal(0), Decimal(4)), (3, day, 8, Decimal(1), Decimal(0))]
    df = spark.createDataFrame(rows, live.DOCUMENTS).coalesce(1)
    df.write.parquet(feed)
    df.where("change_id < 3").coalesce(1).write.mode("append").parquet(feed)
    totals = live.balance(live.read_feed(spark, feed, live.DOCUMENTS, 1), seen_for="1 hour")
    live.keep(totals, out, mark).awaitTermination()
    got = {r["party_id"]: r["balance"] for r in live.latest(spark, out, "party_id", "balance").collect()}
    assert got == {7: Decimal(6), 8: Decimal(1)}


def test_snapshots_bound_what_is_read(spark, tmp_path):
    """Fifty batches in groups of eight; one snapshot was lost before it was marked."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    feed = str(tmp_path / "feed")
    spark.range(0).selectExpr("id AS change_id", "current_timestamp() AS changed_at", "id AS product_id", "CAST(1 AS decimal(18,2)) AS moved").write.parquet(feed)
    assert live.latest(spark, out, "product_id", "moved").count() == 0
    for part in range(2):
        rows = spark.range(25 * 40).selectExpr("id AS change_id", "timestamp '2024-02-01' AS changed_at", "id % 90 AS product_id", "CAST(1 AS decimal(18,2)) AS moved")
        rows.repartition(25).write.mode("append").parquet(feed)
        totals = live.stock(live.read_feed(spark, feed, live.MOVES, files_per_batch=1))
        live.keep(totals, out, mark, group=8).awaitTermination()
    assert live.sinks.marked(spark, f"{out}/done", "group") == list(range(6))
    now = live.latest(spark, out, "product_id", "moved")
    assert len({f.rpartition("/")[0] for f in now.inputFiles()}) <= 1 + 8
    want = spark.read.schema(live.MOVES).parquet(feed).groupBy("product_id").agg(F.sum("moved").cast("decimal(28,2)").alias("moved"))
    assert same(now, want) == 90
    shutil.rmtree(tmp_path / "out/done/group=5")        # stopped between snapshot and mark
    assert same(live.latest(spark, out, "product_id", "moved"), spark.read.schema("product_id bigint, moved decimal(28,2)").parquet(f"{out}/snapshots/group=5")) == 90
