"""Lexical retrieval packing: windows filled with a document's nearest unused neighbours.

BM25 counts documents and their mean length over the whole table; terms are the
token ids.  Documents are given to shards by content: a tree of hyperplanes
through projected BM25 weights, learned from a sample of up to ``SAMPLE``
documents, puts those that share heavy terms next to each other.  The sample also
tells how much of the table each leaf holds, so a document's place in the leaf
(copies: a hash of its number) tells its place in the table and its shard, in one
pass and without a look at the others.  The token ids are staged once; one shuffle
brings a shard together.  A seed is ranked against its own shard: how many of the
nearest documents of the whole table that reaches is measured in ``README.md``.

A document fills as many whole windows as it can alone.  What is left over
seeds a window: the index ranks the shard's unused documents for it, and their
leftovers fill the window in that order.  The one that no longer fits is cut;
its rest seeds the next window.  So only the last window of a shard is padded.
Ties go to the document that comes first.

Ids are those of the ``tokenizers`` library for the same vocabulary, computed with
``tiktoken``, which gives the same ids in a quarter of the time; long runs, of blanks
or of anything else, are encoded by ``byte_bpe``, whose work is linear.  With ``added``, tokens that the vocabulary's
JSON file adds (``<|endoftext|>``) are one id where a text spells them, as that
library has it by default; without, they are text like any other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tradeledger.llm.byte_bpe import coder, read_ranks
from tradeledger.llm.common import importable, in_slices
from tradeledger.sources.sinks import staging_path

WINDOW = 1024
SHARD = 4096
SHARD_TOKENS = 8_000_000    # a shard closes here too
SAMPLE = 65_536             # documents that the tree is learned from
_LEAF, _DIMENSIONS = 32, 64
END = 0                     # id after each document
PIECE = 500                 # pieces from so many characters on are encoded by ``byte_bpe``
LONG = 50_000               # texts from so many characters on are looked at for runs of ``_RUN``
_RUN = r"\s{20000}|\w{20000}|[^\s\w]{20000}"
_COMMON = 8                 # terms that one in so many documents of a shard holds are scored for all pairs at once
_K1, _B = 1.2, 0.75


@lru_cache(maxsize=2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    whole = Path(public_tokenizers.path(name)).with_suffix(".json")      # not every vocabulary has one
    added = {x["content"]: x["id"] for x in json.loads(whole.read_text("utf-8"))["added_tokens"]} if whole.exists() else {}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(name)), special_tokens=added)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex

        self.name, self.encoding = name, _encoding(name)
        self.added = sorted(self.encoding.special_tokens_set)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall

    def _long(self, text: str) -> bytes:
        """Piece by piece: the library's own patterns overflow on a run of a million blanks."""
        small = self.encoding.encode_ordinary
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += small(piece) if len(piece) < PIECE else coder(self.name)[0].encode_piece(piece.encode())
        return np.array(ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text; tokens that the JSON file adds are text like any other."""
        if len(text) >= LONG and re.search(_RUN, text):
            return self._long(text)
        return self.encoding.encode_to_numpy(text, disallowed_special=()).tobytes()

    def __call__(self, text: str, added: bool) -> bytes:
        if not added or not any(x in text for x in self.added):
            return self.plain(text)
        parts = re.split(f"({'|'.join(map(re.escape, self.added))})", text)
        return b"".join(np.array([self.encoding.encode_single_token(p)], "<u4").tobytes() if p in self.added else self.plain(p) for p in parts)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


class Corpus:
    """What BM25 needs to know of all documents: their number, mean length, and for each term the number that hold it."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = n, max(mean, 1)
        # Terms in half of the documents or more weigh nothing.
        self.idf = np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1))

    def weights(self, terms: np.ndarray, counts: np.ndarray, lengths) -> np.ndarray:
        tf = counts.astype(float)
        return self.idf[terms] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * lengths / self.mean))


def terms_of(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, term, count)`` of the different ids of each document, in order."""
    sizes = np.array([len(d) for d in documents], np.int64)
    flat = np.concatenate(documents) if len(documents) else np.zeros(0, "<u4")
    narrow = len(documents) < 1 << 16 and (not len(flat) or flat.max() < 1 << 16)
    kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
    key = np.repeat(np.arange(len(documents), dtype=kind) << kind(shift), sizes)
    key |= flat.astype(kind)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> kind(shift)).astype(np.int64), (key & kind((1 << shift) - 1)).astype(np.int64), counts


class Index:
    """BM25 over documents given as id arrays, with the counts of ``corpus``, or of these documents alone."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus | None = None):
        n = len(documents)
        lengths = np.array([len(d) for d in documents], float)
        owner, flat, counts = terms_of(documents)
        corpus = corpus or Corpus(n, lengths.mean(), np.bincount(flat, minlength=1))
        idf = corpus.idf
        weight = corpus.weights(flat, counts, lengths[owner])
        kept = idf[flat] > 0
        owner, flat, weight = owner[kept], flat[kept], weight[kept]
        held = np.bincount(flat, minlength=len(idf))
        common = held * _COMMON >= n
        # Common terms, whose lists are long, as one product of "holds it" by weight, rounded so that no order of summing shows.
        place = np.cumsum(common) - 1
        here = common[flat]
        weights = np.zeros((n, int(common.sum())), np.float32)
        weights[owner[here], place[flat[here]]] = weight[here]
        self.shared = np.empty((n, n), np.float32)
        for start in range(0, n, 512):
            self.shared[start:start + 512] = (weights[start:start + 512] > 0).astype(np.float32) @ weights.T
        del weights
        owner, flat, weight = owner[~here], flat[~here], weight[~here]
        self.terms = np.split(flat, np.searchsorted(owner, np.arange(1, n)))
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.starts = np.searchsorted(flat[order], np.arange(len(idf) + 1))
        self.size = n

    def scores(self, document: int) -> np.ndarray:
        """Of every document for one as the query, to three decimals."""
        terms = self.terms[document]
        total = self.shared[document].astype(float)
        if len(terms):
            spans = list(zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist()))
            owner = np.concatenate([self.owner[a:b] for a, b in spans])
            total += np.bincount(owner, np.concatenate([self.weight[a:b] for a, b in spans]), self.size)
        return np.round(total, 3)


def pack(documents: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard; sequences count from 0."""
    pieces, sequence = [], 0
    rest = np.zeros(len(documents), np.int64)
    for d, ids in enumerate(documents):
        whole = len(ids) // window
        for k in range(whole):
            pieces.append((d, k * window, window, sequence, 0))
            sequence += 1
        rest[d] = len(ids) - whole * window
    unused = rest > 0
    left = np.flatnonzero(unused)
    if not len(left):
        return pieces
    index = Index(documents, corpus)
    seed, seed_at, next_seed = -1, 0, 0
    while True:
        if seed < 0:                                            # the first document not used yet
            while next_seed < len(left) and not unused[left[next_seed]]:
                next_seed += 1
            if next_seed == len(left):
                return pieces
            seed = int(left[next_seed])
            seed_at = len(documents[seed]) - int(rest[seed])
            unused[seed] = False
        used = len(documents[seed]) - seed_at
        pieces.append((seed, seed_at, used, sequence, 0))
        ranked = None
        query, seed = seed, -1
        while used < window:
            if ranked is None:
                ranked = np.where(unused, index.scores(query), -1.0)
            best = int(ranked.argmax())
            if ranked[best] < 0:
                return pieces
            start = len(documents[best]) - int(rest[best])
            taken = min(int(rest[best]), window - used)
            pieces.append((best, start, taken, sequence, used))
            used += taken
            ranked[best], unused[best] = -1.0, False
            if taken < rest[best]:
                seed, seed_at = best, start + taken
        sequence += 1


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("ids")]


def _runs(documents: list[np.ndarray], limit: int = 1_000_000):
    """Consecutive documents of about ``limit`` ids (a longer one alone)."""
    start = total = 0
    for i, ids in enumerate(documents):
        if i > start and total + len(ids) > limit:
            yield documents[start:i]
            start, total = i, 0
        total += len(ids)
    if start < len(documents):
        yield documents[start:]


def _corpus(staged: DataFrame) -> Corpus:
    """Counts over all documents; a task sends one row per term, and one (term -1) with its documents and ids."""
    def apply(batches):
        df, n, length = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            for documents in _runs(_arrays(batch)):
                here = np.bincount(terms_of(documents)[1], minlength=len(df))
                here[:len(df)] += df
                df, n, length = here, n + len(documents), length + sum(map(len, documents))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[n, df[held]]), pa.array(np.r_[length, 0 * held])], names=["term", "df", "length"])

    rows = staged.select("ids").mapInArrow(apply, "term bigint, df bigint, length bigint").groupBy("term").agg(F.sum("df"), F.sum("length")).collect()
    found = {r[0]: (r[1], r[2]) for r in rows}
    n, length = found.pop(-1, (0, 0))
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = [x for x, _ in found.values()]
    return Corpus(n, length / max(n, 1), df)


@lru_cache(maxsize=1)
def _directions(terms: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((terms, _DIMENSIONS), np.float32)


def vectors(documents: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """BM25 weights of each document in ``_DIMENSIONS`` random directions, of length one."""
    directions = _directions(len(corpus.idf))
    out, i = np.zeros((len(documents), _DIMENSIONS), np.float32), 0
    for part in _runs(documents):
        owner, terms, counts = terms_of(part)
        weights = corpus.weights(terms, counts, np.array([len(d) for d in part], float)[owner]).astype(np.float32)
        cuts = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            out[i] = weights[a:b] @ directions[terms[a:b]]
            i += 1
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


class Tree:
    """Hyperplanes that halve a sample again and again along its widest direction; node ``k`` has the children ``2k + 1`` and ``2k + 2``."""

    def __init__(self, sample: np.ndarray):
        self.depth = max(0, int(np.log2(max(len(sample), 1) / _LEAF)))
        self.normals = np.zeros(((2 << self.depth) - 1, _DIMENSIONS), np.float32)    # the last level orders a leaf
        self.cuts = np.zeros(len(self.normals), np.float32)
        parts = [sample]
        for k in range(len(self.normals)):
            part, parts[k] = parts[k], None
            if len(part):
                centred = part - part.mean(axis=0)
                _, axes = np.linalg.eigh(centred.T @ centred)
                self.normals[k] = axes[:, -1]
            at = part @ self.normals[k]
            order = np.argsort(at, kind="stable")
            half = len(part) // 2
            self.cuts[k] = at[order[half]] if len(part) else 0
            parts += [part[order[:half]], part[order[half:]]]
        leaf, at = self.place(sample)
        by = np.lexsort((at, leaf))
        #: Places of the sample in each leaf, ascending, told as those of any document.
        self.ordered = [x for x in np.split(at[by], np.searchsorted(leaf[by], np.arange((1 << self.depth), (2 << self.depth) - 1)))]

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point, and its place in the leaf."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", points, self.normals[node]) >= self.cuts[node])
        return node, np.einsum("ij,ij->i", points, self.normals[node])


def learned(staged: DataFrame, corpus: Corpus, sample: int = SAMPLE) -> Tree:
    """The tree of up to about ``sample`` documents, chosen by a hash of their number."""
    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors(_arrays(batch), corpus)], pa.binary())], names=["v"])

    chosen = staged.where(F.pmod(F.xxhash64("n"), F.lit(corpus.n)) < sample).select("ids")
    found = sorted(bytes(r["v"]) for r in chosen.mapInArrow(apply, "v binary").collect())
    return Tree(np.frombuffer(b"".join(found), np.float32).reshape(-1, _DIMENSIONS))


class Map:
    """Where a document stands in the table, from 0 to 1: the share of the sample before it.

    Documents that equal a sampled one stand anywhere in that one's share, by a hash
    of their number, so that a group of copies of any size is spread over as many
    shards as it fills.
    """

    def __init__(self, tree: Tree):
        self.tree, self.first = tree, (1 << tree.depth) - 1
        self.before = np.r_[0, np.cumsum([len(x) for x in tree.ordered])]

    def position(self, points: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, leaf and place in the leaf; ``spread`` is a number from 0 to 1 of each document."""
        leaf, at = self.tree.place(points)
        slot = leaf - self.first
        low, high = np.zeros(len(points)), np.zeros(len(points))
        for k in np.unique(slot):
            mine = slot == k
            row = self.tree.ordered[k]
            low[mine], high[mine] = np.searchsorted(row, at[mine], "left"), np.searchsorted(row, at[mine], "right")
        # Between two sampled places, or before and behind all: half a place of room on either side.
        low, high = np.where(low == high, low - 0.5, low), np.where(low == high, high + 0.5, high)
        size = np.diff(self.before)[slot]
        inside = np.clip(low + (high - low) * spread, 0, size)
        return (self.before[slot] + inside) / max(1, self.before[-1]), leaf, at.astype(float)


def placed(staged: DataFrame, corpus: Corpus, tree: Tree, shard: int) -> DataFrame:
    """``staged`` with ``shard`` in the order of content, shards of four fifths of ``shard`` on average, brought together."""
    shards = 1 if corpus.n <= shard else -(-5 * corpus.n // (4 * shard))
    where = Map(tree)

    def apply(batches):
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.uint64)
            spread = ((n * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)
            position, leaf, at = where.position(vectors(_arrays(batch), corpus), spread)
            number = np.minimum((position * shards).astype(np.int64), shards - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(leaf), pa.array(at)], names=[*batch.schema.names, "shard", "leaf", "at"])

    rows = staged.mapInArrow(apply, staged.select("*").schema.add("shard", "long").add("leaf", "long").add("at", "double"))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "leaf", "at", "n")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard: int = SHARD,
           name: str = "byte_bpe_50k.tiktoken", added: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (unsigned 32-bit, little-endian), ``doc_tokens, sequence_id, offset``.

    Every document ends with id ``END``.  A null text counts as empty.  Rows that
    repeat an id are packed one by one.  ``docs`` may have other columns.
    """
    spark = importable(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def encode(batches):
        encode_text, end = encoder(name), np.array([END], "<u4").tobytes()
        n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in in_slices(batches, text, 4_000_000):
            ids = [encode_text(words.as_py() or "", added) + end for words in batch.column(text)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(ids))), batch.column(doc_id), pa.array(ids, pa.binary())], names=["n", "doc_id", "ids"])
            n += len(ids)

    def apply(batches):
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held_ids, held, size, sequence = [], [], 0, 0

        def emit():
            nonlocal sequence
            pa.default_memory_pool().release_unused()       # what earlier tasks of this worker have left
            pieces = pack(held, window, corpus)
            for k in range(0, len(pieces), 1000):
                part = pieces[k:k + 1000]
                columns = list(zip(*part))
                yield pa.RecordBatch.from_arrays([
                    pa.array([held_ids[d] for d in columns[0]], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                    pa.array([held[d][start:start + length].tobytes() for d, start, length, _, _ in part], pa.binary()),
                    pa.array([len(held[d]) for d in columns[0]], pa.int64()),
                    pa.array([base + sequence + s for s in columns[3]], pa.int64()), pa.array(columns[4], pa.int64()),
                ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += max(p[3] for p in pieces) + 1
            held_ids.clear()
            held.clear()

        now = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for key, number, ids in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), _arrays(batch)):
                if held and number != now:
                    yield from emit()
                    size = 0
                now = number
                held_ids.append(key)
                held.append(ids)
                size += len(ids)
                if len(held) >= shard or size >= SHARD_TOKENS:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()

    path = staging_path(spark, "packing")
    docs.select(docs[doc_id], F.make_valid_utf8(docs[text]).alias(text)).mapInArrow(encode, f"n bigint, doc_id {kind}, ids binary").write.parquet(path)
    staged = spark.read.parquet(path)
    corpus = _corpus(staged)
    if not corpus.n:
        return spark.createDataFrame([], schema)
    rows = placed(staged, corpus, learned(staged, corpus), shard)
    return rows.select("doc_id", "ids", "shard").mapInArrow(apply, schema)
