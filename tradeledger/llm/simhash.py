"""Near-duplicate texts by SimHash, compared bit-sliced.

1. Each text's fingerprint: the bitwise majority of the XXH64 hashes of its
   three-word shingles, repeats counted.  Equal fingerprints become one row.
2. Two fingerprints that differ in at most two of 64 bits agree on at least two
   of four 16-bit fields.  So each fingerprint goes to six tables, one per pair
   of fields, and meets the others that share those 32 bits.  A value shared by
   more than ``CROWD`` fingerprints is refined: among the other 32 bits the same
   argument holds for four 8-bit fields, so its rows go on to six finer keys of
   48 bits.  A finer key has 2^16 fingerprints at most, so every group that a
   task compares is bounded, and no pair is lost.
3. A task holds its groups one after another as 64 bit planes.  Shift by shift,
   the planes are compared with themselves: carry-save counters (ones, twos)
   add up 64 lanes of distance per word, and words whose lanes have all passed
   the radius are abandoned.  Links of a group leave as one star per class.
4. Stars are joined into components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeledger.llm.common import checkpointed, in_slices
from tradeledger.llm.components import components

RADIUS = 2
SHINGLE = 3
CROWD = 512     # fingerprints that share 32 bits and are compared without refining
_SLICE = 4_000_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text: A-Z folded, words split at ASCII white space, no words: zero."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, last, 100_000):
        end = min(last, start + 100_000)
        if last == 1:
            hashes = [digest(join(found), 42)]
        else:
            hashes = [digest(join(s), 42) for s in zip(*(found[start + k:end + k] for k in range(words)))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a 64-bit fingerprint (as a signed long) in place of the text."""
    kept = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*kept).schema.add(name, "long")

    def apply(batches):
        for part in in_slices(batches, text, _SLICE):
            prints = np.array([fingerprint(t) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(prints)], names=[*kept, name])

    return docs.select(*kept, text).mapInArrow(apply, schema)


def _sound(text: F.Column) -> F.Column:
    return F.make_valid_utf8(text).alias("text")


def _keys(bits: int, value: str, salt: str) -> F.Column:
    """For each two of four fields of ``bits`` bits of ``value``: a key of their place and content."""
    mask = (1 << bits) - 1
    field = lambda i: f"(shiftrightunsigned({value}, {i * bits}) & {mask})"
    return F.expr("array(" + ", ".join(
        f"struct(xxhash64({salt}, {n}, {field(i)}, {field(j)}) AS key, {n} AS place)" for n, (i, j) in enumerate(combinations(range(4), 2))) + ")")


def _others() -> F.Column:
    """The 32 bits of ``fp`` that its 32-bit key does not name, by the key's place."""
    field = lambda i: f"(shiftrightunsigned(fp, {16 * i}) & 65535)"
    rest = [sorted({0, 1, 2, 3} - {*c}) for c in combinations(range(4), 2)]
    return F.expr("CASE place " + " ".join(f"WHEN {n} THEN {field(i)} | shiftleft({field(j)}, 16)" for n, (i, j) in enumerate(rest)) + " END")


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``i < j`` of one group (equal neighbours in ``group``) whose 64-bit values differ in ``radius`` bits at most.

    Bit planes are compared with themselves shifted by 1, 2, ... rows.
    """
    if radius > 2:
        raise ValueError("two counter planes hold radii up to 2")
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)      # rows from here to the group's end
    words = -(-n // 64)
    planes = np.zeros((64, words * 8), np.uint8)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if n else np.zeros((0, 64), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, :packed.shape[1]] = packed
    planes = np.c_[planes.view("<u8"), np.zeros((64, 1), np.uint64)]
    longest = np.maximum.reduceat(left, np.arange(0, n, 64)) if n else left
    order = np.argsort(-longest, kind="stable")
    reach = -longest[order]
    found_i, found_j = [], []
    for shift in range(1, int(sizes.max(initial=1))):
        block = order[:np.searchsorted(reach, -shift)]          # words that hold a row with a partner so far on
        block = np.sort(block)
        skip, bit = divmod(shift, 64)
        low, high = block + skip, np.minimum(block + skip + 1, words)
        lanes = np.zeros(len(block) * 64, bool)
        rows = (block[:, None] * 64 + np.arange(64)).ravel()
        inside = rows < n
        lanes[inside] = left[rows[inside]] > shift
        alive = np.packbits(lanes, bitorder="little").view("<u8")
        ones = np.zeros(len(block), np.uint64)
        twos = np.zeros(len(block), np.uint64)
        down, up = np.uint64(bit), np.uint64((64 - bit) % 64)
        for b, plane in enumerate(planes):
            other = plane[np.minimum(low, words)]
            if bit:
                other = (other >> down) | (plane[high] << up)
            differ = plane[block] ^ other
            carry = ones & differ
            ones ^= differ
            over = twos & carry
            twos |= carry
            # Four and more stay above any radius of two counters; three is above a radius of two.
            alive &= ~(over | (ones & twos)) if radius == 2 else ~(over | twos) if radius == 1 else ~(ones | twos)
            if b % 6 == 5:
                keep = alive != 0
                if not keep.any():
                    block = block[:0]
                    break
                if not keep.all():
                    block, low, high, alive, ones, twos = (x[keep] for x in (block, low, high, alive, ones, twos))
        if len(block):
            hit = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(hit)
            i = block[word] * 64 + lane
            found_i.append(i)
            found_j.append(i + shift)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that it is linked with through pairs ``i < j``."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    while True:
        nxt = label[label]
        if (nxt == label).all():
            return label
        label = nxt


def _compare(batches):
    """Links of rows ``(key, fp)`` that arrive sorted by key: each row to the first of its class."""
    held: list[pa.RecordBatch] = []

    def links(parts):
        whole = pa.Table.from_batches(parts)
        key, fp = (whole.column(c).to_numpy() for c in ("key", "fp"))
        i, j = close_pairs(fp.view(np.uint64), key)
        first = stars(len(key), i, j)
        own = np.flatnonzero(first != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[first[own]])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:                                         # the last key may go on in the next batch
            held.append(batch.slice(0, cut))
            yield links(held)
            held = []
        elif held and held[-1].column("key")[-1].as_py() != key[0]:
            yield links(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield links(held)


def link_prints(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that keep every class of radius two together."""
    rows = prints.select("fp", F.explode(_keys(16, "fp", "0")).alias("k")).select("fp", "k.key", "k.place")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, "key")
    finer = (
        met.where(f"n > {crowd}").withColumn("rest", _others())
        .select("fp", F.explode(_keys(8, "rest", "key")).alias("k")).select("k.key", "fp")
    )
    grouped = met.where(f"n <= {crowd}").select("key", "fp").union(finer)
    return grouped.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare, "a bigint, b bigint")


def _classes(docs: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The documents ``doc_id, fp``, and for each fingerprint ``fp, class, component_id``."""
    prints = checkpointed(with_fingerprint(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(link_prints(nodes.select("fp"), crowd))
    classes = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    named = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    return prints, classes.select("fp", "class").join(named, "class")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable), ``class`` (the smallest fingerprint reachable, as a long).

    A null text counts as empty; texts without words have fingerprint zero and
    link like any other.  Bytes that are no UTF-8 count as U+FFFD.  Repeated rows
    come back repeated.  Null ids are never the smallest of a class that has
    another.  ``docs`` may have other columns.
    """
    prints, classes = _classes(docs.select(docs[doc_id].alias("doc_id"), _sound(docs[text])), crowd)
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` for each class of ``near_duplicates``: a row with the class's smallest id, or any row of a class without ids.

    Rows of different classes that share an id all stay; repeated rows are one
    class.  The columns are those of ``docs``, whatever their names.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), _sound(docs[text]), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    prints, classes = _classes(rows.select("doc_id", "text"), crowd)
    # Of each class one id and fingerprint, told without the texts; these are then brought together once.
    found = prints.distinct().join(classes, "fp").where("doc_id <=> component_id")
    chosen = found.groupBy("class").agg(F.min(F.struct(*_key(), "fp")).alias("k")).select("k.*")
    printed = with_fingerprint(rows).select(*_key(), "fp", "row")
    kept = printed.join(chosen, ["id", "nameless", "fp"], "left_semi").dropDuplicates(["id", "nameless", "fp"])
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def _key() -> list[F.Column]:
    """An id as columns that are never null."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("nameless")]
