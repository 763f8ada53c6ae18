"""Reports for a set of parties that read only the files holding them.

Document tables are written in ranges of their party, line tables in ranges of
their document, each with an index row per file: the first and last key in it.  A
key set is held against the index before anything is scanned; the files it names
are read, and the rest of the report runs over these tables like over any others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeledger.sources.tables import Tables, write_clustered

PARTY = "customer_id"
# Tables by party, and line tables with their document table and its key.
HEADS = ("orders", "special_orders", "grass", "kasbons", "payments", "special_payments")
LINES = {"order_details": ("orders", "order_id"), "special_details": ("special_orders", "order_id"),
         "grass_details": ("grass", "grass_id"), "grass_costs": ("grass", "grass_id")}


def write(t: Tables, base: str, names: Iterable[str], files: int) -> None:
    """Write the tables ``names`` below ``base`` in about ``files`` ranges each, with their index."""
    for name in names:
        df, key = getattr(t, name), LINES[name][1] if name in LINES else PARTY
        write_clustered(df, f"{base}/{name}", [key, "id"], files)
        stored = df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")
        stored.select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key")).groupBy("file").agg(
            F.min("key").alias("first"), F.max("key").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{base}/_index/{name}")


def files_of(spark: SparkSession, base: str, name: str, keys: DataFrame) -> list[str]:
    """The files of a table that may hold one of the one-column ``keys``; at most all of its files."""
    index = spark.read.parquet(f"{base}/_index/{name}")
    near = keys.toDF("key").distinct().join(F.broadcast(index), F.expr("key BETWEEN first AND last"))      # a row per file
    return sorted(r[0] for r in near.select("file").distinct().collect())


def _some(t: Tables, base: str, name: str, key: str, keys: DataFrame) -> DataFrame:
    shape = getattr(t, name).schema
    spark = keys.sparkSession
    paths = files_of(spark, base, name, keys)
    rows = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    return rows.join(keys.toDF(key).distinct(), key, "left_semi").select(*shape.names)


def tables_of(t: Tables, base: str, names: Iterable[str], customers: DataFrame) -> Tables:
    """The tables ``names``, as written, of the one-column ``customers`` only; other tables (products, parties) as they are in ``t``."""
    names = list(names)
    made = {n: _some(t, base, n, PARTY, customers) for n in names if n not in LINES}
    for n in names:
        if n in LINES:
            parent, key = LINES[n]
            made[n] = _some(t, base, n, key, made[parent].select("id"))
    return t.having(**made)
