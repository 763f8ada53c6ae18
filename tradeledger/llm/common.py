"""What several text operators share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeledger.sources.sinks import shared_folder


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 2_000       # rows that go to a Python worker at once: they hold whole texts


def importable(spark: SparkSession) -> SparkSession:
    """Python workers of this session find the package where the driver does (elsewhere pass it with ``--py-files``).

    They get ``BATCH`` rows at a time, unless the session says so already.
    """
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, BATCH)
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, or the like that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sound(df: DataFrame, column: str) -> Column:
    """A text column in which bytes that are no UTF-8 have become U+FFFD, as Python needs it."""
    return F.make_valid_utf8(df[f"`{column}`"])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose id's CRC-32, as text, leaves 2 by 4.  A null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later steps and lost executors read it there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_rows(df: DataFrame, by: str | None, on: str, buckets: int) -> DataFrame:
    """At most ``buckets`` rows' texts per value of ``by``: the smallest hash of ``on`` in each hash bucket.

    The choice depends on the texts alone, so copies count once and it is the
    same on every run.  Rows that share a chosen text all come back.
    """
    key = F.xxhash64(on)
    group = [F.col(by)] if by else []
    least = df.where(F.col(on).isNotNull()).groupBy(*group, F.pmod(key, F.lit(buckets)).alias("_bucket")).agg(F.min(key).alias("_least"))
    return df.where(key.isin([r["_least"] for r in least.collect()]))


def in_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows that hold about ``limit`` characters of ``column`` (a longer text stays alone)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
