"""Pages at any depth: tables in ranges of their order, with an index that counts what lies before each.

``store`` writes a table sorted across files, one range each, and an index row per
file: its first position, its rows, and the rows before it.  A page is then read
from the one or two files that hold it, whatever it skips.  Positions end in a
unique column, so equal values lie in one order and are never parted differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def store(df: DataFrame, path: str, by: list[str], unique: str, files: int) -> None:
    """Write ``df`` in about ``files`` ranges below ``path``; choose them to hold some million rows.  Nulls come first."""
    order = [*by, unique]
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.struct(*order).alias("at"))
    ranges = rows.groupBy("file").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # One row per file: few enough for one task.
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ranges.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def _ordered(spark: SparkSession, path: str, found: list, by: list[str], unique: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return (spark.read.schema(rows.schema).parquet(*[r["file"] for r in found]) if found else rows.limit(0)).orderBy(*by, unique)


def page(spark: SparkSession, path: str, by: list[str], unique: str, skip: int = 0, take: int = 20) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` in order; only files that hold some of them are read."""
    index = spark.read.parquet(f"{path}/index")
    found = index.where((F.col("before") < skip + take) & (F.col("before") + F.col("rows") > skip)).orderBy("before").collect()
    return _ordered(spark, path, found, by, unique).offset(skip - (found[0]["before"] if found else 0)).limit(take)


def page_after(spark: SparkSession, path: str, by: list[str], unique: str, last: tuple, take: int = 20) -> DataFrame:
    """The ``take`` rows behind the row at position ``last`` (values of ``by`` and ``unique``, none null), there or not."""
    index = spark.read.parquet(f"{path}/index").orderBy("before")
    kinds = index.schema["first"].dataType
    at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, kinds)])
    # From the last file that begins at or before the position, as many as hold ``take`` more rows.
    start = index.where(F.col("first") <= at).agg(F.max("before").alias("b")).first()["b"] or 0
    first = index.where(F.col("before") == start).select("rows").first()
    if first is None:
        return _ordered(spark, path, [], by, unique)
    found = index.where((F.col("before") >= start) & (F.col("before") < start + first["rows"] + take)).collect()
    return _ordered(spark, path, found, by, unique).where(F.struct(*by, unique) > at).orderBy(*by, unique).limit(take)


def rank_of(spark: SparkSession, path: str, by: list[str], unique: str, at: tuple) -> int:
    """How many rows stand before position ``at``."""
    index = spark.read.parquet(f"{path}/index")
    kinds = index.schema["first"].dataType
    position = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(at, kinds)])
    held = index.where(F.col("first") < position).orderBy(F.desc("before")).limit(1).collect()
    return held[0]["before"] + _ordered(spark, path, held, by, unique).where(F.struct(*by, unique) < position).count() if held else 0
