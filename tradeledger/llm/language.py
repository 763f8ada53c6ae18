"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a bounded sample
of labelled text.  A new text is parsed greedily against each automaton: a
phrase is the longest stretch that occurs in the sample.  The language that
needs the fewest phrases, times the bits that name one, wins.

The automata are dense tables, joined into one array, and many stretches of
text walk through them in step, one array operation per character.  Texts are
cut into blocks of ``BLOCK`` symbols for that; a phrase ends where its block
ends, in every language alike.

Texts are folded first: letters to lower case, everything else to one blank.
``text`` null or without letters gives ``und`` and score 0.  Ties go to the
language with more labelled rows.  Without labelled rows every text is ``und``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeledger.llm.common import bounded_rows, fresh, held_out, in_slices, sound

BLOCK = 256             # symbols parsed in one go
SLICE = 600_000         # characters that walk in step
ALPHABET = 120          # letters told apart; rarer ones share a symbol
PASSAGES = 64           # sampled passages per language
TRAINING = 120_000      # sampled characters of all languages together
LANGUAGES = 200         # languages learned, the most frequent first

_BLANK, _RARE = 0, 1


@dataclass(frozen=True)
class Model:
    """``steps[state + symbol]`` is the next state, negative where a phrase ends first.  States are table offsets."""

    languages: tuple[str, ...]
    letters: str
    roots: np.ndarray
    bits: np.ndarray
    steps: np.ndarray


@lru_cache(maxsize=2)
def _symbols(letters: str) -> np.ndarray:
    """Symbol of every code point."""
    symbol = np.zeros(0x110000, np.uint8)
    known = {c: i + 2 for i, c in enumerate(letters)}
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            symbol[point] = known.get(c.lower()[:1], _RARE)
    return symbol


def _fold(text: str, symbol: np.ndarray) -> np.ndarray:
    """Symbols of a text, with runs of blanks as one."""
    found = symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = found != _BLANK
    keep[1:] |= found[:-1] != _BLANK
    return found[keep]


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


def build(samples: dict[str, list[str]]) -> Model:
    """The model of passages per language; earlier languages win ties."""
    languages = tuple(samples)
    letters = Counter(c.lower()[:1] for texts in samples.values() for t in texts for c in t if c.isalpha())
    letters = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])
    symbol, gap, pad = _symbols(letters), len(letters) + 2, len(letters) + 3
    width = len(letters) + 4
    blocks, roots, bits, base = [], [], [], 1
    for language in languages:
        sequence: list[int] = []
        for text in samples[language]:
            sequence += _fold(text, symbol).tolist() + [gap]
        moves = _automaton(sequence)
        root, alone = base * width, (base + len(moves)) * width
        first = np.full(width, -alone, np.int64)  # a symbol the sample lacks is a phrase of its own
        for c, target in moves[0].items():
            first[c] = -(base + target) * width
        grid = np.tile(first, (len(moves) + 1, 1))
        grid[0] = -first
        for state, out in enumerate(moves):
            for c, target in out.items():
                grid[state, c] = (base + target) * width
        grid[:, pad] = root
        blocks.append(grid.ravel())
        roots.append(root)
        bits.append(math.ceil(math.log2(max(2, len(sequence)))))
        base += len(moves) + 1
    steps = np.concatenate([np.zeros(width, np.int64), *blocks]) if blocks else np.zeros(width, np.int64)
    return Model(languages, letters, np.array(roots, np.int64), np.array(bits, float), steps.astype(np.int32))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", passages: int = PASSAGES, training: int = TRAINING,
        languages: int = LANGUAGES) -> Model:
    """Learn from rows with a language.

    The sample is bounded: up to ``passages`` stretches per language, ``training``
    characters in all, over the ``languages`` most frequent values.
    """
    rows = labelled.select(F.col(lang).alias("lang"), sound(labelled, text).alias("text")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not known:
        return build({})
    chars = max(50, training // (passages * len(known)))
    key = F.xxhash64("text", F.lit(1))
    start = F.pmod(key, F.greatest(F.char_length("text") - F.lit(chars), F.lit(0)) + 1).cast("int") + 1
    chosen = bounded_rows(rows.where(F.col("lang").isin(known)), "lang", "text", passages)
    samples: dict[str, list[str]] = {language: [] for language in known}
    for r in chosen.select("lang", F.substring("text", start, F.lit(chars)).alias("passage")).distinct().orderBy("lang", "passage").collect():
        samples[r["lang"]].append(r["passage"])
    return build(samples)


def phrases(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per text and language, and symbols per text (0 without letters)."""
    symbol, pad = _symbols(model.letters), len(model.letters) + 3
    folded = [_fold(t, symbol) if t else np.zeros(0, np.uint8) for t in texts]
    sizes = np.array([len(f) if (f != _BLANK).any() else 0 for f in folded], np.int64)
    blocks = -(-sizes // BLOCK)
    counts = np.zeros((len(texts), len(model.languages)))
    if not blocks.sum() or not model.languages:
        return counts, sizes
    lanes = np.full((int(blocks.sum()), BLOCK), pad, np.uint8)
    flat, at = lanes.reshape(-1), 0
    for f, size, n in zip(folded, sizes, blocks):
        flat[at:at + size] = f[:size]
        at += n * BLOCK
    owner = np.repeat(np.arange(len(texts)), blocks)
    columns = np.ascontiguousarray(lanes.T).astype(np.int32)
    roots = model.roots.astype(np.int32)[:, None]
    state = np.repeat(roots, len(lanes), axis=1)
    ended = np.zeros(state.shape, np.int32)
    for column in columns:
        state += column
        state = model.steps.take(state)
        ended += state < 0
        np.abs(state, out=state)
    for k in range(len(model.languages)):
        counts[:, k] = np.bincount(owner, ended[k], len(texts))
    # What a block still holds at its end is a phrase too; padding has ended those of short blocks.
    counts += np.bincount(owner, minlength=len(texts))[:, None]
    return counts, sizes


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    counts, sizes = phrases(model, texts)
    out, scores = [], []
    for row, size in zip(counts * model.bits if model.languages else counts, sizes):
        if not size or not model.languages:
            out.append("und")
            scores.append(0.0)
            continue
        best = int(row.argmin())
        rest = np.delete(row, best)
        out.append(model.languages[best])
        scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
    return out, scores


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: how many fewer bits than the next language needs).

    A text that is null or has no letter is ``und``.  Of languages that need equally
    many bits the first is taken.  Bytes that are no UTF-8 count as U+FFFD.  Repeated
    rows come back repeated; columns with the names of the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]
    rows, read = docs.select(*(docs[f"`{c}`"] for c in kept)), fresh(docs.columns, "_read")
    schema = rows.schema.add("lang_pred", "string").add("score", "double")

    def apply(batches):
        for part in in_slices(batches, read, SLICE):
            found, score = classify(shared.value, part.column(read).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                             names=[*kept, "lang_pred", "score"])

    return docs.select(*(docs[f"`{c}`"] for c in kept), sound(docs, text).alias(read)).mapInArrow(apply, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all rows, learned from the labelled ones that are not held out.

    Repeated rows come back repeated; other columns of ``docs`` play no part.
    """
    model = fit(docs.where(~held_out(doc_id)), text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model, keep_text=False)
