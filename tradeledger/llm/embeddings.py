"""Near-duplicate vectors: sign hashing in several tables, exact cosines, components.

* Equal vectors are one class; the classes are compared, the copies counted.
* A table's key is the signs of ``bits`` random hyperplanes.  Two vectors at the
  threshold agree on one sign with ``p = 1 - acos(threshold) / pi``, in one table
  with ``p ** bits``.  ``bits`` follows the number of vectors, so that a bucket
  of unrelated vectors stays small, and the number of tables follows from
  ``bits`` and the wanted ``recall`` at the threshold (closer pairs are found
  more surely).
* A bucket above ``block`` rows is cut into blocks by hash; each pair of blocks
  is a group of its own, so the largest group is two blocks at any size.
* In a group cosines come from one matrix product in double precision.  A pair
  is counted in the first table that finds it, so pairs are never shuffled;
  links leave as one star per class and group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from tradeledger.llm.common import checkpointed
from tradeledger.llm.components import components
from tradeledger.llm.simhash import stars

THRESHOLD = 0.9
RECALL = 0.97   # at the threshold itself
BLOCK = 2048
_SEED = 20240229


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table and number of tables for ``n`` different vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(10, math.ceil(math.log2(max(n, 1) / 8)))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits)))


def _keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """``(rows, tables)`` keys."""
    planes = np.random.default_rng(_SEED).standard_normal((tables * bits, vectors.shape[1]))
    signs = (vectors @ planes.T > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _signed(bits: int, tables: int):
    def apply(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("dim"))
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                keys = _keys(_matrix(part.column("v")), bits, tables)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "keys"])
    return apply


def _links(threshold: float, square: int):
    def compare(rows: pa.Table):
        """Counts and stars of one group: rows of block ``lo`` against those of block ``hi``."""
        if rows.num_rows < 2:
            return
        table = rows.column("t")[0].as_py()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        block, lo, hi = rows.column("block").to_numpy(), rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        vectors = _matrix(rows.column("v").combine_chunks())
        keys = np.array(rows.column("keys").combine_chunks().flatten(), np.int64).reshape(rows.num_rows, table)
        length = np.sqrt((vectors * vectors).sum(axis=1))
        left = np.flatnonzero(block == lo)
        right = np.flatnonzero(block == hi)
        found_i, found_j = [], []
        for start in range(0, len(left), square):
            i = left[start:start + square]
            cosine = (vectors[i] @ vectors[right].T) / length[i][:, None] / length[right][None, :]
            x, y = np.nonzero(cosine >= threshold - 1e-9)
            x, y = i[x], right[y]
            if lo == hi:
                x, y = x[x < y], y[x < y]
            exact = (vectors[x] * vectors[y]).sum(axis=1) / (length[x] * length[y]) >= threshold
            new = exact & ~(keys[x] == keys[y]).any(axis=1)
            found_i.append(x[new])
            found_j.append(y[new])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if not len(i):
            return
        counts = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        first = stars(len(node), np.minimum(i, j), np.maximum(i, j))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[first[some]]), pa.array(counts[some].astype(np.int64))],
                                         names=["a", "b", "n"])

    def apply(batches):
        """Rows arrive sorted by group; a group may span batches."""
        held, group = [], None
        for batch in batches:
            ids = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    if held and ids[start] != group:
                        yield from compare(pa.Table.from_batches(held))
                        held = []
                    group = ids[start]
                    held.append(batch.slice(start, end - start))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return apply


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    A vector that is null, empty, zero or holds null, NaN or infinity links with
    nothing: 0 links, its own component, kept.  Vectors of different length
    never link.  Repeated rows are copies of each other.  A null id counts as a
    link of others; such a row names no class and is not kept.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"))
    sound = F.expr("coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0), false)")
    rows = rows.withColumn("v", F.when(sound, F.col("v"))).withColumn("node", F.xxhash64("v", F.size("v")))
    classes = checkpointed(
        rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.min("node").alias("node"))
    )
    n = classes.count()
    bits, tables = plan(n, threshold, recall)
    plain = classes.select("node", "copies", "v", F.size("v").alias("dim"))
    signed = checkpointed(plain.mapInArrow(_signed(bits, tables), plain.select("*").schema.add("keys", ArrayType(LongType()))))

    # Bucket sizes are found without the vectors: a vector's tables with large buckets, if any, come back as one short list.
    entry = signed.select("node", F.posexplode("keys").alias("t", "key"), "dim")
    large = entry.groupBy("t", "key", "dim").agg(F.count("*").alias("n")).where(f"n > {block}")
    cut = (
        entry.join(large, ["t", "key", "dim"]).groupBy("node")
        .agg(F.map_from_entries(F.collect_list(F.struct("t", F.expr(f"ceil(n / {block})")))).alias("cut"))
    )
    spread = (
        signed.join(cut, "node", "left").select("*", F.posexplode("keys").alias("t", "key"))
        .withColumn("keys", F.expr("slice(keys, 1, t)"))                # the tables before this one
        .withColumn("blocks", F.expr("coalesce(cut[t], 1L)"))
        .withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .select(F.xxhash64("t", "key", "dim", "lo", "hi").alias("g"), "t", "lo", "hi", "block", "node", "copies", "v", "keys")
    )
    found = checkpointed(
        spread.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_links(threshold, 512), "a bigint, b bigint, n bigint")
    )
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found)
    every = (
        classes.select("node", "first", "copies").join(counts, "node", "left").join(joined, "node", "left")
        .select("node", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    )
    named = every.groupBy("class").agg(F.min("first").alias("component_id"))
    known = every.join(named, "class").select("node", "n_links", "component_id")
    single = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("v IS NOT NULL").select("vec_id", "node").join(known, "node").select("vec_id", "n_links", "component_id")
    return linked.union(single).withColumn("kept", F.expr("coalesce(vec_id = component_id, false)"))
