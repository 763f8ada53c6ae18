"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period ``q``, at least
``max(least, 2 q)`` long, that no neighbouring word continues.  Texts are
searched many at a time, as one sequence of (text, word) numbers:

1. Ranks by the first 1, 2, 4, ... words are refined until none is shared.  They
   name every stretch of a power of two words, tell how far two places agree
   (longest common extension, both ways), and end in the suffix array.
2. A run's first period holds an aligned block of a quarter to half its length,
   and the block occurs again ``q`` places on.  So each block (if shared at all)
   asks for its occurrences in the window behind it: the next place at or after
   another, among the suffixes that start with the block, is a range successor
   query on a wavelet tree over the suffix array.
3. Two occurrences close together mean that the block itself has their distance
   as its period, and that the occurrences go on as a progression.  A progression
   within the block's own periodic stretch has the period of the block.  One in another
   stretch gives the two periods that align starts or ends, and all its members
   where the stretches touch.
4. Every candidate period is extended both ways; what is long enough and has no
   shorter period over the same words is a run.

Steps are numpy operations over all texts of a slice.  The ranks take four bytes
a word for each level, and there are levels only as far as some stretch repeats.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tradeledger.llm.common import in_slices

LEAST = 12          # words of the shortest run
_SLICE = 2_000_000  # bytes of text searched at a time (a longer text stays alone)


class Places:
    """Ranks of all places of a sequence by their first 1, 2, 4, ... numbers, and the suffix array."""

    def __init__(self, text: np.ndarray, numbers: np.ndarray):
        n = len(numbers)
        key = text.astype(np.int64) * (int(numbers.max(initial=0)) + 1) + numbers
        self.n, self.order = n, np.argsort(key, kind="stable").astype(np.int32)
        rank, active = self._ranked(np.zeros(n + 1, np.int32), self.order, np.zeros(n, np.int32), key[self.order])
        rank[n] = -1
        self.ranks = [rank]
        width = 1
        # ``active``: slots of the order whose places share a rank with others.
        while len(active):
            places = self.order[active]
            follow = rank[np.minimum(places + width, n)].astype(np.int64)
            by = np.argsort(rank[places].astype(np.int64) * (n + 2) + follow + 1, kind="stable")
            places, follow = places[by], follow[by]
            self.order[active] = places
            pair = rank[places].astype(np.int64) * (n + 2) + follow + 1
            rank, shared = self._ranked(rank.copy(), places, active, pair)
            active = active[shared]
            self.ranks.append(rank)
            width *= 2

    @staticmethod
    def _ranked(rank: np.ndarray, places: np.ndarray, slots: np.ndarray, keys: np.ndarray):
        """Places in key order get the slot at which their key starts; also which of them share it."""
        if not len(places):
            return rank, np.zeros(0, np.int64)
        slots = slots if slots.any() else np.arange(len(places))
        new = np.r_[True, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(places)])
        rank[places] = np.repeat(slots[starts], sizes)
        return rank, np.flatnonzero(np.repeat(sizes > 1, sizes))

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from ``i`` and ``j`` on agree (``i <> j``)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][i] == self.ranks[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers right before ``i`` and ``j`` agree (``i < j``)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            width = 1 << k
            a = np.maximum(i - width, 0)
            same = (i >= width) & (self.ranks[k][a] == self.ranks[k][np.maximum(j - width, 0)])
            i[same] -= width
            j[same] -= width
        return start - i


class Wavelet:
    """A wavelet tree over a sequence of different numbers, laid out level by level, for range successors."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        rest = values
        for level in range(self.depth - 1, -1, -1):
            bit = (rest >> level) & 1 == 1
            words = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, bool)], bitorder="little").view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int32)].astype(np.int32)
            self.levels.append((words, before, self.size - int(bit.sum())))
            rest = np.concatenate([rest[~bit], rest[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` entries of a level have their bit set."""
        words, before, _ = self.levels[level]
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int32)

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value not below ``least`` among entries ``low`` to ``high`` (exclusive); -1 where there is none."""
        below, a, b = np.zeros(len(low), np.int64), low.copy(), high.copy()
        for level in range(self.depth):                 # how many entries are smaller
            one_a, one_b = self._ones(level, a), self._ones(level, b)
            up = (least >> (self.depth - 1 - level)) & 1 == 1
            below += np.where(up, (b - a) - (one_b - one_a), 0)
            zeros = self.levels[level][2]
            a, b = np.where(up, zeros + one_a, a - one_a), np.where(up, zeros + one_b, b - one_b)
        below = np.where(least >> self.depth > 0, high - low, below)
        there = below < high - low
        a, b, nth = low.copy(), high.copy(), np.where(there, below, 0)
        value = np.zeros(len(low), np.int64)
        for level in range(self.depth):                 # the entry of that place in order
            one_a, one_b = self._ones(level, a), self._ones(level, b)
            few = (b - a) - (one_b - one_a)
            up = nth >= few
            nth = np.where(up, nth - few, nth)
            zeros = self.levels[level][2]
            a, b = np.where(up, zeros + one_a, a - one_a), np.where(up, zeros + one_b, b - one_b)
            value = value * 2 + up
        return np.where(there, value, -1)


def _windows(longest: int, least: int):
    """``(k, first, last)``: blocks of ``2 ** k`` words look for periods from ``first`` to ``last``.

    A run of period ``q`` repeats a stretch of ``max(least - q, q)`` words at least
    ``q`` places on, and a stretch of ``2 b - 1`` holds an aligned block of ``b``.
    Each period goes to the largest block that this allows.
    """
    found: dict[int, list[int]] = {}
    q = 1
    while q <= longest // 2 and q <= least:
        found.setdefault((max(least - q, q) + 1 >> 1).bit_length() - 1, []).append(q)
        q += 1
    for k, periods in found.items():
        cuts = [i for i in range(len(periods)) if i == 0 or periods[i] != periods[i - 1] + 1]
        for a, b in zip(cuts, [*cuts[1:], len(periods)]):
            yield k, periods[a], periods[b - 1]
    while q <= longest // 2:
        k = (q + 1 >> 1).bit_length() - 1
        last = min((4 << k) - 2, longest // 2)
        yield k, q, last
        q = last + 1


def _candidates(places: Places, tree: Wavelet, k: int, first: int, last: int):
    """Pairs ``(place, period)`` to be extended, from the blocks of ``2 ** k`` words."""
    width = 1 << k
    if k >= len(places.ranks):
        return                                          # no stretch this long occurs twice
    rank = places.ranks[k]
    i = np.arange(0, places.n - width + 1, width)
    by_order = rank[places.order]
    low = rank[i].astype(np.int64)
    high = np.searchsorted(by_order, low, "right")
    shared = high - low > 1
    i, low, high = i[shared], low[shared], high[shared]
    least, stop = i + first, i + last
    while len(i):
        one = tree.successor(low, high, least)
        there = (one >= 0) & (one <= stop)
        i, low, high, stop, one = (x[there] for x in (i, low, high, stop, one))
        if not len(i):
            return
        two = tree.successor(low, high, one + 1)
        step = two - one
        periodic = (two >= 0) & (2 * step <= width)
        yield i[~periodic], (one - i)[~periodic]
        least = one + 1
        if periodic.any():
            a, b, p, end = i[periodic], one[periodic], step[periodic], stop[periodic]
            here_start, here_end = a - places.left(a, a + p), a + p + places.right(a, a + p)
            there_start, there_end = b - places.left(b, b + p), b + p + places.right(b, b + p)
            other = here_start != there_start
            own = ~other & (p >= first) & (p <= last)       # only where short runs need not be twice as long as the block
            yield a[own], p[own]
            for period in (there_start - here_start, there_end - here_end):     # starts or ends aligned
                fits = other & (period >= first) & (period <= last)
                yield a[fits], period[fits]
            touch = other & (here_end >= there_start)
            final = np.minimum(there_end - width, end)
            count = np.where(touch, np.maximum((final - b) // p + 1, 0), 0)
            which = np.repeat(np.arange(len(a)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            yield a[which], b[which] + nth * p[which] - a[which]
            least[periodic] = there_end - width + 1


def runs_of(text: np.ndarray, numbers: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start, then period; ``text`` tells which text a number is of (texts follow one another)."""
    none = np.zeros(0, np.int64)
    longest = int(np.bincount(text).max(initial=0)) if len(text) else 0
    if longest < least:
        return none, none, none
    places = Places(text, numbers)
    if len(places.ranks) < 2:
        return none, none, none
    tree = Wavelet(places.order.astype(np.int64))
    found = []
    for k, first, last in _windows(longest, least):
        for i, q in _candidates(places, tree, k, first, last):
            if not len(i):
                continue
            left, right = places.left(i, i + q), places.right(i, i + q)
            long = left + right + q >= np.maximum(least, 2 * q)
            found.append(np.stack([(i - left)[long], (left + right + q)[long], q[long]]))
    if not any(f.size for f in found):
        return none, none, none
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    shortest = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]     # over the same words only the smallest period counts
    start, length, period = start[shortest], length[shortest], period[shortest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _searched(texts: list[bytes], least: int):
    """For each text its number of words, its runs, and the words that stay."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    every = list(chain.from_iterable(words))
    numbers = dict(zip(dict.fromkeys(every), count()))
    flat = np.fromiter(map(numbers.__getitem__, every), np.int64, len(every))
    owner = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = runs_of(owner, flat, least)
    whose = owner[start] if len(start) else start
    dropped = np.zeros(len(flat) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    stays = np.cumsum(dropped)[:-1] == 0
    cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
    for d, own in enumerate(words):
        a, b = cuts[d], cuts[d + 1]
        rows = [(int(s - first[d]), int(n), int(q)) for s, n, q in zip(start[a:b], length[a:b], period[a:b])]
        if rows:
            own = [w for w, s in zip(own, stays[first[d]:first[d] + len(own)].tolist()) if s]
        yield len(words[d]), rows, b" ".join(own)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` [(start, length, period)] by start, then period, and ``collapsed`` in place of the text.

    Words are parted by ASCII white space and numbered from 0.  ``collapsed`` holds,
    joined by one blank, the words that no run contains after its first period.  A
    null or empty text has no words, no runs and an empty ``collapsed``.  Bytes that
    are no UTF-8 count as U+FFFD.  Repeated rows come back repeated.  Columns with
    the names of the new ones are replaced, others stay.
    """
    new = StructType.fromDDL("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    kept = [c for c in docs.columns if c != text and c not in new.names]
    rows = docs.select(*(docs[f"`{c}`"] for c in kept), F.make_valid_utf8(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias(text))
    schema = StructType(rows.select(*(F.col(f"`{c}`") for c in kept)).schema.fields + new.fields)
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def apply(batches):
        for part in in_slices(batches, text, _SLICE):
            found = list(_searched([t.as_py().encode() for t in part.column(text)], least))
            lists = [[{"start": s, "length": n, "period": q} for s, n, q in f[1]] for f in found]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array(lists, run), pa.array([f[2].decode() for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *new.names])

    return rows.mapInArrow(apply, schema)
