"""Running sums over parties of any size, as one lazy plan.

A window puts all rows of one party into one task.  So parties above about
``hot_rows`` rows, told from a sample of the very rows that are summed, are cut
into chunks that follow the sort order (``operators.cuts``).  Rows are shuffled
once, by party and chunk.  Windows run inside the chunks; chunk totals, added up
from the same shuffle, one small row each, are summed per party and added back as
an offset.  The result is the same, exactly.

Nothing runs while the plan is built, and a filter on the party reaches every
scan.  Cut points and offsets are broadcast: there are ``MOST_CHUNKS`` (50,000) of
them at most, because chunks grow with the table beyond that, and each is a party,
a position or a few sums: 10 MB in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeledger.operators.cuts import HOT_ROWS, bounded_cut_points, chunk

_AT, _CHUNK, _ROW, _CUT = "_at", "_chunk", "_row", "_cut"


def with_chunks(df: DataFrame, parts: list[str], order: list[str], hot_rows: int = HOT_ROWS,
                keys: DataFrame | None = None, size: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_chunk`` (-1 for all rows of parties that are not large), and the cut points of the large ones.

    ``keys`` are the rows' ``parts`` and ``order``, exact or nearly, where they can be had without the work
    behind ``df``; ``size`` is any frame of as many rows.  They only decide where the cuts are, never the result.
    """
    keyed = (df if keys is None else keys).select(*parts, F.struct(*order).alias(_AT))
    # Told here, not only by the joins, so that all that join with the cut points share them.
    cuts = bounded_cut_points(keyed, parts, _AT, hot_rows, size).where(" AND ".join(f"`{p}` IS NOT NULL" for p in parts))
    cut = df.withColumn(_AT, F.struct(*order)).join(F.broadcast(cuts), parts, "left")
    return cut.withColumn(_CHUNK, F.when(F.col("cuts").isNull(), -1).otherwise(chunk(_AT))).drop(_AT, "cuts"), cuts


def shuffled(df: DataFrame, parts: list[str], order: list[str], values: dict[str, Column], hot_rows: int = HOT_ROWS,
             keys: DataFrame | None = None, size: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``parts``, ``_chunk``, ``values`` and all other columns as ``_row``, shuffled by party and chunk; and the cut points.

    What reads all of these columns shares one shuffle; see ``per_chunk``.
    """
    cut, cuts = with_chunks(df, parts, order, hot_rows, keys, size)
    rest = [n for n in df.columns if n not in parts]
    # A row that might be null for all the optimizer knows, so that counting it counts as reading it.
    row = F.when(F.col(_CHUNK) >= -1, F.struct(*rest)).alias(_ROW)
    return cut.select(*parts, _CHUNK, *[v.alias(n) for n, v in values.items()], row).repartition(*parts, _CHUNK), cuts


def per_chunk(base: DataFrame, cuts: DataFrame, parts: list[str], *aggregates: Column) -> DataFrame:
    """One row per chunk of the large parties.

    Whether a chunk is one of these is told after the grouping, and all columns of
    ``base`` are read, so that the shuffle below is the very one that the windows use.
    The join with ``cuts`` is above that shuffle: where no party is large, which is known
    before it runs, the join is empty and none of this is left.  It compares null-safely,
    since a plain one would put its own filter below the shuffle and make it another one.
    """
    large = F.broadcast(cuts.select(*[F.col(p).alias(f"_p_{p}") for p in parts]))
    held = base.join(large, [F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in parts])
    grouped = held.groupBy(*parts, _CHUNK).agg(*aggregates, F.max(_CHUNK).alias(_CUT), F.count(_ROW).alias("_rows"))
    return grouped.where(f"{_CUT} >= 0 AND _rows > 0").drop(_CUT, "_rows")


def running(df: DataFrame, parts: list[str], order: list[str], sums: dict[str, Column], hot_rows: int = HOT_ROWS,
            keys: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """Add ``sums`` as running sums within ``parts`` along ``order``, which tells the rows of a party apart."""
    base, cuts = shuffled(df, parts, order, {f"_v_{n}": v for n, v in sums.items()}, hot_rows, keys, size)
    inside = Window.partitionBy(*parts, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flat = base.select(*parts, _CHUNK, *[f"_v_{n}" for n in sums], f"{_ROW}.*")
    local = flat.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums})
    types = {name: kind for name, kind in local.select(*sums).dtypes}
    earlier = Window.partitionBy(*parts).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk(base, cuts, parts, *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]).select(
        *parts, _CHUNK, *[F.sum(f"_t_{n}").over(earlier).alias(f"_before_{n}") for n in sums])
    return (
        local.join(F.broadcast(offsets), [*parts, _CHUNK], "left")
        .withColumns({n: (F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).cast(types[n]) for n in sums})
        .select(*df.columns, *[n for n in sums if n not in df.columns])
    )


def following(df: DataFrame, parts: list[str], key: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the next greater ``key`` of the party as ``name``, null for the last; keys are unique."""
    base, cuts = shuffled(df, parts, [key], {"_key": F.col(key)}, hot_rows)
    inside = Window.partitionBy(*parts, _CHUNK).orderBy("_key")
    local = base.withColumn(name, F.lead("_key").over(inside))
    firsts = per_chunk(base, cuts, parts, F.min("_key").alias("_first")).select(
        *parts, _CHUNK, F.lead("_first").over(Window.partitionBy(*parts).orderBy(_CHUNK)).alias("_later"))
    found = local.join(F.broadcast(firsts), [*parts, _CHUNK], "left").withColumn(name, F.coalesce(name, "_later"))
    return found.select(*parts, name, f"{_ROW}.*").select(*df.columns, name)
