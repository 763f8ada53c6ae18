"""Cutting large keys into chunks along an order.

A window puts all rows of one key into one task.  Rows of keys above a size are
therefore cut along their order: a hash sample of the key's own positions gives
its cut points, every ``_FINE``-th sampled position one, so chunks hold about
``hot_rows`` rows wherever the positions bunch.  All of it is a lazy plan:
nothing runs while it is built, and a filter on the key reaches every scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_ROWS = 2_000_000    # rows of one key that a single task sorts comfortably
MOST_CHUNKS = 50_000    # chunks that ``bounded_cut_points`` makes of a whole table, about
_FINE = 32              # sampled positions per chunk


def cut_points(positions: DataFrame, keys: list[str], position: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``keys`` and ``cuts``, the ascending cut points of every key with more than ``hot_rows`` rows.

    ``position`` may repeat; equal positions are never parted, so give one that
    tells rows apart (a struct) where equal values can be many.
    """
    rate = max(1, hot_rows // _FINE)
    one = F.xxhash64(*keys, position, F.lit(17))
    sizes = positions.groupBy(*keys).agg(F.count("*").alias("_rows")).where(f"_rows > {hot_rows}")
    sampled = positions.where(F.pmod(one, F.lit(rate)) == 0).select(*keys, position) if rate > 1 else positions.select(*keys, position)
    # Few rows are sampled and fewer keys are large, so this window stays small next to the keys it cuts.
    numbered = (
        sampled.join(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
        .withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(position)))
    )
    return numbered.where(f"_n % {_FINE} = 0").groupBy(*keys).agg(F.array_sort(F.collect_set(position)).alias("cuts"))


def bounded_cut_points(positions: DataFrame, keys: list[str], position: str, hot_rows: int = HOT_ROWS, size: DataFrame | None = None) -> DataFrame:
    """The same from the sample alone, and few enough to broadcast: above ``MOST_CHUNKS * hot_rows`` rows chunks grow with the table.

    Positions are sampled before anything moves, by a hash that needs no key, so
    that the sample is taken at the scan, below any join that finds the key.  A key
    is large if its sampled positions, ``_FINE`` per ``hot_rows`` rows, say so; they
    meet in one row.  A key with fewer than a chunk's samples is not listed.
    ``size`` has as many rows as ``positions`` or more, and is only counted.
    """
    rate = max(1, hot_rows // _FINE)
    fine = max(1, min(_FINE, hot_rows))
    sampled = positions.where(F.pmod(F.xxhash64(position, F.lit(17)), F.lit(rate)) == 0) if rate > 1 else positions
    total = (positions if size is None else size).agg(F.count(F.lit(1))).scalar()
    wide = F.ceil(F.greatest(F.lit(1.0), total / F.lit(float(MOST_CHUNKS * hot_rows)))).cast("int")
    return (
        sampled.groupBy(*keys).agg(F.collect_list(position).alias("_sample")).withColumn("_wide", wide)
        .where(f"size(_sample) * {rate}L > {hot_rows} AND size(_sample) >= {fine} * _wide")
        .select(*keys, F.expr(f"filter(array_sort(_sample), (x, i) -> (i + 1) % ({fine} * _wide) = 0)").alias("cuts"))
    )


def chunk(position: str, cuts: str = "cuts") -> Column:
    """Number of a row's chunk: the cut points below its position, found by halving; 0 for keys without cuts."""
    return F.expr(
        f"CASE WHEN {cuts} IS NULL THEN 0 ELSE aggregate(sequence(0, 31), named_struct('lo', 0, 'hi', size({cuts})), "
        f"(a, i) -> IF(a.lo >= a.hi, a, IF({cuts}[(a.lo + a.hi) div 2] < {position}, "
        f"named_struct('lo', CAST((a.lo + a.hi) div 2 + 1 AS INT), 'hi', a.hi), named_struct('lo', a.lo, 'hi', CAST((a.lo + a.hi) div 2 AS INT)))), a -> a.lo) END")


def with_chunk(df: DataFrame, keys: list[str], position: str, hot_rows: int = HOT_ROWS, positions: DataFrame | None = None, name: str = "_chunk") -> DataFrame:
    """``df`` with the chunk number of each row within its key.  ``positions``: the rows that are counted, ``df`` if none are given."""
    cuts = cut_points(df if positions is None else positions, keys, position, hot_rows)
    cuts = cuts.select(*[F.col(k).alias(f"_{k}") for k in keys], "cuts")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(cuts, same, "left").withColumn(name, chunk(position)).drop("cuts", *[f"_{k}" for k in keys])
