"""Totals kept current from a feed of changes.

Sums commute, so late rows need no watermark and state is one row per key.
Only a feed that repeats rows needs one: give ``change_id`` and ``seen_for``.

The sink writes each micro-batch's changed keys to its own folder and replaces
that folder when a batch is repeated, so a lost executor or a restart changes
nothing.  After every group of batches it writes a snapshot of all keys.
``latest`` reads the last snapshot and the few batches after it; folders of
earlier groups are history.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tradeledger.functions.money import TOTAL
from tradeledger.sources import sinks

c = F.col

GROUP = 50      # batches between snapshots

# The feeds' columns.
MOVES = "change_id bigint, changed_at timestamp, product_id bigint, moved decimal(18,2)"
DOCUMENTS = "change_id bigint, changed_at timestamp, party_id bigint, debt decimal(18,2), cred decimal(18,2)"


def read_feed(spark: SparkSession, path: str, shape: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(feed: DataFrame, seen_for: str | None) -> DataFrame:
    """Drop redelivered changes that arrive within ``seen_for`` of each other."""
    if seen_for is None:
        return feed
    return feed.withWatermark("changed_at", seen_for).dropDuplicatesWithinWatermark(["change_id"])


def stock(feed: DataFrame, seen_for: str | None = None) -> DataFrame:
    """Net movement per product."""
    return once(feed, seen_for).groupBy("product_id").agg(F.sum("moved").cast(TOTAL).alias("moved"))


def balance(feed: DataFrame, seen_for: str | None = None) -> DataFrame:
    """Open balance per party."""
    return once(feed, seen_for).groupBy("party_id").agg(
        F.sum(c("debt") - c("cred")).cast(TOTAL).alias("balance"))


def keep(totals: DataFrame, out: str, checkpoint: str, every: str | None = None, group: int = GROUP) -> StreamingQuery:
    """Write the changed keys of every batch, and after each ``group`` of batches the value of every key.

    Drains the feed and stops, or runs on with a batch ``every`` so often.  A
    snapshot counts once it is marked, so a restart in the middle repeats it.
    """
    key, value = totals.columns

    def write(batch: DataFrame, number: int) -> None:
        spark, n = batch.sparkSession, number // group
        batch.write.mode("overwrite").parquet(f"{out}/batches/group={n}/batch={number}")
        if number % group == group - 1:
            latest(spark, out, key, value).write.mode("overwrite").parquet(f"{out}/snapshots/group={n}")
            sinks.mark(spark, f"{out}/done", "group", n)

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def latest(spark: SparkSession, out: str, key: str, value: str) -> DataFrame:
    """The newest value per key over all batches written so far; no rows before the first.

    Reads the last snapshot and the batches after it, of one group.
    """
    shape = f"{key} bigint, {value} {TOTAL}"
    done = sinks.marked(spark, f"{out}/done", "group")
    after = done[-1] + 1 if done else 0
    try:
        newer = spark.read.schema(f"{shape}, batch bigint").parquet(f"{out}/batches/group={after}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newer = spark.createDataFrame([], f"{shape}, batch bigint")
    if done:
        newer = newer.unionByName(spark.read.schema(shape).parquet(f"{out}/snapshots/group={done[-1]}").withColumn("batch", F.lit(-1).cast("bigint")))
    return newer.groupBy(key).agg(F.max_by(value, "batch").alias(value))
