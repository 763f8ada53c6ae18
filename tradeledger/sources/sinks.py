"""Where results and staged tables go."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else one in the warehouse.

    A warehouse on the driver's own disk is one that executors cannot read, so on
    a cluster it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse and _default_store(spark).startswith("file:")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir; the warehouse is on the driver's disk")
    return f"{warehouse}/_staging"


def _default_store(spark: SparkSession) -> str:
    """Where paths without a scheme lead."""
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tradeledger/{name}-{uuid.uuid4().hex}"


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def mark(spark: SparkSession, folder: str, name: str, number: int) -> None:
    """Note that number ``number`` is complete; call it last.  Marking twice is marking once."""
    spark.range(1).selectExpr("id AS row").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}={number}")


def marked(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers marked so far, ascending."""
    try:
        return sorted(r[name] for r in spark.read.schema(f"row bigint, {name} bigint").parquet(folder).select(name).distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a whole new version of a table beside the old ones, publish it, and return its path.

    Parquet rows cannot be changed in place.  A version counts once it is marked
    as published, so a failed or repeated write leaves readers on the one before,
    and readers of an old version keep it.
    """
    path = f"{base}/version={version}"
    df.write.mode("overwrite").parquet(path)
    mark(df.sparkSession, f"{base}/published", "version", version)
    return path


def current_path(spark: SparkSession, base: str) -> str:
    """Folder of the newest published version of a table."""
    versions = marked(spark, f"{base}/published", "version")
    if not versions:
        raise ValueError(f"nothing has been published below {base}")
    return f"{base}/version={versions[-1]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets several reports share
    one computation.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
