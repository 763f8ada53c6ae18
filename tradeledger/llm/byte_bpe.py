"""Byte-level BPE by longest matches and backtracking.

A token sequence is the one that BPE's merges give exactly when each pair of
neighbours is: merging would not have joined them otherwise.  So a piece of
text is encoded from left to right.  Aho-Corasick finds the tokens that start
at each byte (bytes are mapped to Latin-1 characters for it); the longest that
is compatible with its left neighbour is taken, and where none fits the last
token gives way to the next shorter one.  A position found hopeless is never
tried again, so the work is linear in the piece.  Compatibility of two tokens
is memoised, and so are whole pieces, both in bounded tables.

Texts are cut into pieces by the tokenizer's own pattern first.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tradeledger.llm.common import in_slices, sound

PIECES = 300_000        # pieces remembered by a task, twice over
PAIRS = 500_000         # token pairs remembered
_SLICE = 4_000_000


class Memo(dict):
    """A mapping that computes what it lacks, and keeps the ``size`` newest entries and as many older ones that were used since."""

    def __init__(self, of, size: int):
        super().__init__()
        self.of, self.size, self.old = of, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        if value is None:
            value = self.of(key)
        self[key] = value
        return value


class Coder:
    """Encoder and decoder for a vocabulary of ranks (``{token bytes: rank}``)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.machine.add_word(token.decode("latin-1"), (rank, len(token)))
        self.machine.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits = Memo(self._fits, PAIRS)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token, rank)

    def _learn(self, token: bytes, rank: int) -> None:
        """The two tokens that the last merge of ``token`` joins: the cut whose halves are compatible by earlier merges."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and self._fits((left, right)):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Would merging leave these two tokens side by side?

        Undo merges on either side of the seam from the latest to the earliest.
        A merge across the seam that comes before the one undone last would have
        taken place, so the two could not have formed.
        """
        left, right = pair
        undone = len(self.ranks) + 1
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < undone:
                return False
            if left > right and left in self.halves:
                undone, left = left, self.halves[left][1]
            elif right in self.halves:
                undone, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                undone, left = left, self.halves[left][1]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.machine.iter(piece.decode("latin-1")):
            starts[end + 1 - found[1]].append(found)     # shorter tokens come first
        hopeless = bytearray(n + 1)
        out: list[int] = []
        path: list[tuple[int, int]] = []                # (position, place in its list) of each token
        at, choice = 0, len(starts[0]) - 1
        fits = self.fits
        while at < n:
            options = starts[at]
            while choice >= 0:
                rank, size = options[choice]
                if not hopeless[at + size] and (not out or fits[out[-1], rank]):
                    break
                choice -= 1
            if choice >= 0:
                out.append(rank)
                path.append((at, choice))
                at += size
                choice = len(starts[at]) - 1 if at < n else -1
            else:
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                hopeless[at] = 1
                out.pop()
                at, choice = path.pop()
        return out

    def encode(self, text: str) -> list[int]:
        return [rank for piece in self.pieces(text) for rank in self.encode_piece(piece.encode())]

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def coder(name: str) -> tuple[Coder, Memo]:
    """The coder of a vocabulary file of ``public_tokenizers``, and the memo of its pieces: ``(ids as text, number, decoded)``."""
    import public_tokenizers

    made = Coder(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)

    def of(piece: str):
        ids = made.encode_piece(piece.encode())
        return " ".join(map(str, ids)), len(ids), made.decode(ids)

    return made, Memo(of, PIECES)


def digests(text: str | None, name: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids as decimals joined by blanks, SHA-256 of the bytes that the ids decode to."""
    made, memo = coder(name)
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    pieces = made.pieces(text or "")
    for start in range(0, len(pieces), 100_000):
        part = [memo[p] for p in pieces[start:start + 100_000]]
        ids.update((" " * bool(start) + " ".join([p[0] for p in part])).encode())
        n += sum([p[1] for p in part])
        decoded.update(b"".join([p[2] for p in part]))
    return n, ids.hexdigest(), decoded.hexdigest()


def encoded(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k.tiktoken", lists: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the text, or with ``lists`` the ``ids`` themselves.

    A null text counts as empty: no ids.  Bytes that are no UTF-8 count as U+FFFD.
    Repeated rows come back repeated; columns with the names of the new ones are replaced.
    """
    new = [("ids", "array<int>", pa.list_(pa.int32()))] if lists else [
        ("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    kept = [c for c in docs.columns if c not in (text, *(n for n, *_ in new))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{n} {t}" for n, t, _ in new)])

    def apply(batches):
        for part in in_slices(batches, text, _SLICE):
            texts = part.column(text).to_pylist()
            rows = [(coder(name)[0].encode(t or ""),) for t in texts] if lists else [digests(t, name) for t in texts]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *(n for n, *_ in new)])

    return docs.select(*(docs[f"`{c}`"] for c in kept), sound(docs, text).alias(text)).mapInArrow(apply, schema)


def decoded(docs: DataFrame, ids: str = "ids", name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``docs`` with the ``bytes`` that the ids stand for in place of the ids.  Null ids: null; an id the vocabulary lacks fails."""
    kept = [c for c in docs.columns if c not in (ids, "bytes")]
    schema = docs.select(*kept).schema.add("bytes", "binary")

    def apply(batches):
        for batch in batches:
            found = [None if x is None else coder(name)[0].decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, "bytes"])

    return docs.select(*kept, ids).mapInArrow(apply, schema)
