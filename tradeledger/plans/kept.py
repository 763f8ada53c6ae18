"""Running sums that are kept up to date: a late change re-sums one chunk.

A ledger is stored in chunks of about ``hot_rows`` rows of a party, in entry order.
Rows hold running sums within their chunk.  A summary has, for each chunk, its
greatest position, its rows and its totals.  What lies before a chunk follows from
the summary when the ledger is read, so a change at any place rewrites the chunks
it falls in and their summary rows, and nothing behind them.

Both tables are in one ``buckets.Store`` and change together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tradeledger.operators.cuts import HOT_ROWS
from tradeledger.operators.running import with_chunks
from tradeledger.sources.buckets import Store, bucket, touched
from tradeledger.sources.sinks import staged

CHUNK = "_chunk"
ROWS, SUMMARY = "rows", "summary"


@dataclass(frozen=True)
class Shape:
    """Party columns, the order inside a party (unique), and what is summed: result column to SQL over the row."""

    parts: tuple[str, ...]
    order: tuple[str, ...]
    sums: tuple[tuple[str, str], ...]

    def value(self, name: str) -> str:
        return f"_v_{name}"


def _summed(rows: DataFrame, shape: Shape) -> DataFrame:
    """Running sums within chunks from the rows' own values."""
    inside = Window.partitionBy(*shape.parts, CHUNK).orderBy(*shape.order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.sum(shape.value(n)).over(inside) for n, _ in shape.sums})


def _summary(rows: DataFrame, shape: Shape) -> DataFrame:
    return rows.groupBy(*shape.parts, CHUNK).agg(
        F.max(F.struct(*shape.order)).alias("_last"), F.count("*").alias("_rows"), *[F.sum(shape.value(n)).alias(f"_t_{n}") for n, _ in shape.sums])


def _valued(rows: DataFrame, shape: Shape) -> DataFrame:
    return rows.withColumns({shape.value(n): F.expr(f"CAST({e} AS decimal(28,2))") for n, e in shape.sums})


def build(store: Store, rows: DataFrame, shape: Shape, buckets: int, hot_rows: int = HOT_ROWS) -> int:
    """Store the ledger of ``rows``, which must not have columns named like the sums."""
    cut = with_chunks(rows, list(shape.parts), list(shape.order), hot_rows)[0].withColumn(CHUNK, F.greatest(F.col(CHUNK), F.lit(0)).cast("bigint"))
    kept = _summed(_valued(cut, shape), shape)
    since = store.version()
    placed = store.write(kept, [*shape.parts, CHUNK], buckets)
    written = store.spark.read.schema(placed.shape).parquet(*placed.folders.values()) if placed.folders else store.spark.createDataFrame([], placed.shape)
    return store.publish({ROWS: placed, SUMMARY: store.write(_summary(written, shape), shape.parts, buckets)}, since)


def read(store: Store, shape: Shape, version: int | None = None) -> DataFrame:
    """The ledger: running sums of the chunk plus what the chunks before it add up to."""
    version = store.version() if version is None else version
    rows, summary = store.read(ROWS, version=version), store.read(SUMMARY, version=version)
    party = Window.partitionBy(*shape.parts)
    earlier = party.orderBy("_last").rowsBetween(Window.unboundedPreceding, -1)
    # Parties of one chunk have nothing before it and stay out of the join.
    offsets = (
        summary.withColumn("_chunks", F.count("*").over(party))
        .select(*shape.parts, CHUNK, "_chunks", *[F.sum(f"_t_{n}").over(earlier).alias(f"_before_{n}") for n, _ in shape.sums]).where("_chunks > 1").drop("_chunks")
    )
    kinds = dict(rows.dtypes)
    return (
        rows.join(offsets, [*shape.parts, CHUNK], "left")
        .withColumns({n: (F.col(n) + F.coalesce(f"_before_{n}", F.lit(0))).cast(kinds[n]) for n, _ in shape.sums})
        .drop(CHUNK, *[shape.value(n) for n, _ in shape.sums], *[f"_before_{n}" for n, _ in shape.sums])
    )


def _found(positions: DataFrame, summary: DataFrame, shape: Shape) -> DataFrame:
    """``positions`` with the chunk each falls in: the first whose greatest position is not below, else the last; 0 for new parties."""
    chunks = summary.groupBy(*shape.parts).agg(F.array_sort(F.collect_list(F.struct("_last", CHUNK))).alias("_chunks"))
    at = F.expr(
        "aggregate(sequence(0, 31), named_struct('lo', 0, 'hi', size(_chunks) - 1), (a, i) -> IF(a.lo >= a.hi, a, "
        "IF(_chunks[(a.lo + a.hi) div 2]._last < _at, named_struct('lo', CAST((a.lo + a.hi) div 2 + 1 AS INT), 'hi', a.hi), "
        f"named_struct('lo', a.lo, 'hi', CAST((a.lo + a.hi) div 2 AS INT)))), a -> _chunks[a.lo].{CHUNK})")
    met = positions.withColumn("_at", F.struct(*shape.order)).join(chunks, list(shape.parts), "left")
    return met.withColumn(CHUNK, F.when(F.col("_chunks").isNull(), F.lit(0)).otherwise(at).cast("bigint")).drop("_at", "_chunks")


def change(store: Store, shape: Shape, gone: DataFrame, come: DataFrame, hot_rows: int = HOT_ROWS) -> int:
    """Take rows out (``gone``: party and order columns) and put rows in (``come``: rows without sums); returns the new version.

    A row that changes is in both.  Chunks that grow beyond twice ``hot_rows`` are cut.
    """
    since = store.version()
    parts = store.parts(since)
    place = [*shape.parts, *shape.order]
    of = parts[ROWS].of
    types = {f.name: f.dataType for f in parts[ROWS].shape}
    alike = lambda df, names: df.select(*[F.col(n).cast(types[n]) for n in names])
    # Written once, and again with their chunks: whatever work is behind them, several jobs read them.
    gone = staged(alike(gone, place).distinct(), "gone")
    come = staged(alike(_valued(come, shape), [n for n in parts[ROWS].shape.names if n != CHUNK and n not in {s for s, _ in shape.sums}]), "come")
    named = touched(gone.select(*shape.parts).union(come.select(*shape.parts)), shape.parts, parts[SUMMARY].of)
    summary = store.read(SUMMARY, named, since)
    gone, come = staged(_found(gone, summary, shape), "gone-placed"), staged(_found(come, summary, shape), "come-placed")
    keys = [*shape.parts, CHUNK]
    hit = touched(gone.select(*keys).union(come.select(*keys)), keys, of)
    columns = [n for n in parts[ROWS].shape.names if n not in {s for s, _ in shape.sums}]
    old = store.read(ROWS, hit, since).select(*columns)
    rows = old.join(gone.select(*place), place, "left_anti").select(*columns).unionByName(come.select(*columns))
    # Written once: what follows reads the chunks as they are cut here.
    recut = staged(_recut(rows, summary, shape, hot_rows).select(*columns), "recut")
    rewritten = sorted({*hit, *touched(recut, keys, of)})
    beside = store.read(ROWS, set(rewritten) - set(hit), since).select(*columns)     # of buckets that new chunks fall in
    placed = store.write(alike(_summed(recut.unionByName(beside), shape), parts[ROWS].shape.names), keys, of, rewritten, parts[ROWS])

    files = [f for b, f in placed.folders.items() if b in set(rewritten)]
    written = store.spark.read.schema(placed.shape).parquet(*files) if files else store.spark.createDataFrame([], placed.shape)
    parties = gone.select(*shape.parts).union(come.select(*shape.parts)).distinct()
    by = list(shape.parts)
    still = summary.join(parties, by, "left_semi").where(~bucket(keys, of).isin(rewritten)).unionByName(summary.join(parties, by, "left_anti"))
    resummed = _summary(written.join(parties, by, "left_semi"), shape)
    renewed = still.unionByName(resummed).select(*[F.col(f.name).cast(f.dataType) for f in parts[SUMMARY].shape])
    return store.publish({ROWS: placed, SUMMARY: store.write(renewed, shape.parts, parts[SUMMARY].of, named, parts[SUMMARY])}, since)


def _recut(rows: DataFrame, summary: DataFrame, shape: Shape, hot_rows: int) -> DataFrame:
    """``rows`` with chunks above twice ``hot_rows`` cut: their later rows get chunks of new numbers."""
    keys = [*shape.parts, CHUNK]
    pieces = F.floor((F.col("_n") - 1) / hot_rows)
    before = F.sum(pieces).over(Window.partitionBy(*shape.parts).orderBy(CHUNK)) - pieces
    highest = summary.groupBy(*shape.parts).agg(F.max(CHUNK).alias("_highest"))
    long = (
        rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(f"_n > {2 * hot_rows}").join(highest, list(shape.parts), "left")
        .select(*keys, (F.coalesce("_highest", F.lit(0)) + before).alias("_first"))
    )
    nth = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*shape.order)) - 1) / hot_rows)
    number = F.when(F.col("_nth") == 0, F.col(CHUNK)).otherwise(F.col("_first") + F.col("_nth")).cast("bigint")
    cut = rows.join(long, keys).withColumn("_nth", nth).withColumn(CHUNK, number).select(*rows.columns)
    return rows.join(long, keys, "left_anti").select(*rows.columns).unionByName(cut)
