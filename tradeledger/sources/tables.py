"""The set of model tables a report reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tradeledger import schema
from tradeledger.sources.sinks import current_path


class Tables:
    """Model tables by name; each is built on first use only."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def columns(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a table.  Sources that compute their tables can leave out what other columns need."""
        return getattr(self, name).select(*columns)

    def positions(self, name: str, *columns: str) -> DataFrame:
        """Columns that place rows, for cut points: exact, or near where a source would have to compute them."""
        return self.columns(name, *columns)

    def positions_of(self, names: Iterable[str], *columns: str) -> DataFrame:
        """The positions of several tables in one frame."""
        return reduce(DataFrame.unionByName, [self.positions(n, *columns) for n in names])

    def names(self) -> list[str]:
        return list(self._makers)

    def having(self, **tables: DataFrame) -> "Tables":
        """The same tables with some of them replaced."""
        return Tables({**self._makers, **{n: (lambda d=d: d) for n, d in tables.items()}})


def read_table(spark: SparkSession, name: str, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """One model table from Parquet, ORC, JSON, CSV or, with ``fmt='jdbc'``, a database.

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the read is split over the cluster.
    """
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=source, dbtable=name, **options).load()
    return spark.read.schema(schema.read_schema(name)).format(fmt).options(**options).load(f"{source}/{name}")


def read_tables(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> Tables:
    return Tables({n: (lambda n=n: read_table(spark, n, source, fmt, **options)) for n in schema.DDL})


def read_published(spark: SparkSession, source: str) -> Tables:
    """The newest published version of every table below ``source`` (see ``sinks.write_snapshot``)."""
    read = lambda n: spark.read.schema(schema.read_schema(n)).parquet(current_path(spark, f"{source}/{n}"))
    return Tables({n: (lambda n=n: read(n)) for n in schema.DDL})


def write_clustered(df: DataFrame, path: str, by: list[str], files: int) -> None:
    """Write sorted by ``by`` across ``files`` range partitions.

    Parquet min/max statistics then skip files for party, product or id
    filters, which is what the book's secondary indexes were for.  Ranges are
    sampled, so add an id to ``by`` when one party is large.
    """
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save as a catalog table hashed into ``buckets`` by ``key``.

    Lines and headers bucketed alike by the document id join without a shuffle.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
