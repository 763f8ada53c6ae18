"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes disguises: case, full-width and styled letters, Cyrillic and
Greek look-alikes, invisible characters, digits and signs written for letters
(``1d10t``), and the look-alikes ``i``, ``l`` and ``1``, which become one letter.
Words are then runs of letters, one blank apart.

The lexicon is learned from labelled texts: words and word beginnings that
toxic texts hold far more often than others, each weighted by its smoothed
log-odds.  Phrases of two words that hold such a word, but occur in several
harmless texts and no toxic one, are exceptions and cancel the match inside
them.  A text's matches are put in three figures (weight of different matches,
weight per 100 words, greatest weight), which a logistic curve turns into the
score.  All of it is fitted on a bounded sample of ``SAMPLE`` texts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeledger.llm.common import checkpointed, held_out, in_slices, sound

SAMPLE = 20_000         # labelled texts that are learned from, about
LEXICON = 400           # entries kept, the surest first
EXCEPTIONS = 400
THRESHOLD = 0.3
_SLICE = 600_000

# Letters of other scripts that look like Latin ones, in pairs.
_LOOK_ALIKE = (
    ("а", "a"), ("в", "b"), ("с", "c"), ("ԁ", "d"), ("е", "e"), ("һ", "h"), ("і", "i"), ("ј", "j"), ("к", "k"), ("ӏ", "l"), ("м", "m"),
    ("н", "h"), ("о", "o"), ("р", "p"), ("ԛ", "q"), ("ѕ", "s"), ("т", "t"), ("у", "y"), ("х", "x"), ("ԝ", "w"),
    ("α", "a"), ("β", "b"), ("ε", "e"), ("η", "n"), ("ι", "i"), ("κ", "k"), ("ν", "v"), ("ο", "o"), ("ρ", "p"), ("τ", "t"), ("υ", "u"),
    ("χ", "x"), ("ı", "i"), ("ɑ", "a"), ("ɡ", "g"), ("ο", "o"),
)
_DIGITS = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"), ("9", "g"))
_SIGNS = (("@", "a"), ("$", "s"), ("!", "i"), ("|", "i"))
_SAME = (("l", "i"),)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its folded letter or 0, the letter it stands for as a digit, as a sign, and whether it is invisible."""
    letter, digit, sign = (np.zeros(0x110000, np.uint32) for _ in range(3))
    hidden = np.zeros(0x110000, bool)
    alike, same = dict(_LOOK_ALIKE), dict(_SAME)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            if len(low) != 1 or point > 127:
                plain = unicodedata.normalize("NFKC", low)
                low = plain if len(plain) == 1 else low[:1]
            low = alike.get(low, low)
            letter[point] = ord(same.get(low, low))
        elif point > 127 and unicodedata.category(c) in ("Cf", "Mn"):
            hidden[point] = True
    for c, low in _DIGITS:
        digit[ord(c)] = ord(low)
    for c, low in _SIGNS:
        sign[ord(c)] = ord(low)
    return letter, digit, sign, hidden


def fold(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """All texts in one folded string, a line each, blanks around every word; and the words of each text."""
    letter, digit, sign, hidden = _tables()
    joined = "".join(f" {unicodedata.normalize('NFC', t or '')} \n" for t in texts)
    lengths = np.array([len(unicodedata.normalize("NFC", t or "")) + 3 for t in texts], np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.zeros(len(points), bool)
    ends[np.cumsum(lengths) - 1] = True
    shown = ~hidden[points]
    points, ends = points[shown], ends[shown]
    out = letter[points]
    solid = out != 0
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    out = np.where(~solid & (before | after), digit[points], out)
    out = np.where(~solid & before & after & (out == 0), sign[points], out)
    solid = out != 0
    out[~solid] = 32
    out[ends] = 10
    keep = solid | ends | np.r_[True, (out[:-1] != 32)]
    words = solid & ~np.r_[False, solid[:-1]]
    line = np.cumsum(ends) - ends
    return out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.bincount(line[words], minlength=len(texts))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]       # " word " or " beginning"
    exceptions: tuple[str, ...]     # " two words "
    curve: tuple[float, ...]        # constant, three slopes


def _features(line: str) -> set[str]:
    """Words and beginnings of a folded text, as the automaton would match them."""
    out = set()
    for word in set(line.split()):
        if 3 <= len(word) <= 24:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in range(4, min(8, len(word)) + 1))
    return out


@lru_cache(maxsize=4)
def _matcher(entries: tuple[str, ...], exceptions: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, entry in enumerate(entries):
        machine.add_word(entry, i)
    for i, phrase in enumerate(exceptions):
        machine.add_word(phrase, -1 - i)
    if len(machine):
        machine.make_automaton()
    return machine


def figures(texts: list[str | None], weights: dict[str, float], exceptions: tuple[str, ...]) -> np.ndarray:
    """Per text: weight of different matches, weight of all matches per 100 words, greatest weight."""
    folded, words = fold(texts)
    out = np.zeros((len(texts), 3))
    entries = tuple(weights)
    machine = _matcher(entries, exceptions)
    if not len(machine):
        return out
    lines = np.flatnonzero(np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), "<u4") == 10)
    hits, spared = [], []
    for end, i in machine.iter(folded):
        if i >= 0:
            hits.append((end - len(entries[i]) + 2, i))
        else:
            start = end - len(exceptions[-1 - i]) + 1
            spared += [start + 1, folded.index(" ", start + 1) + 1]
    if not hits:
        return out
    best: dict[int, int] = {}       # where a word starts: its heaviest entry
    for start, i in hits:
        if start not in best or weights[entries[i]] > weights[entries[best[start]]]:
            best[start] = i
    for start in spared:
        best.pop(start, None)
    owner = np.searchsorted(lines, list(best))
    seen: dict[int, Counter] = {}
    for text, i in zip(owner.tolist(), best.values()):
        seen.setdefault(text, Counter())[i] += 1
    for text, found in seen.items():
        value = [weights[entries[i]] for i in found]
        total = sum(weights[entries[i]] * n for i, n in found.items())
        out[text] = sum(value), 100 * total / max(int(words[text]), 20), max(value)
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), x[:, 2]]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a weak prior, by Newton steps."""
    inputs, slope = _inputs(x), np.zeros(4)
    prior = np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(inputs @ slope, -30, 30)))
        step = np.linalg.solve((inputs * (p * (1 - p))[:, None]).T @ inputs + prior, inputs.T @ (y - p) - prior @ slope)
        slope += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(s) for s in slope)


def score(texts: list[str | None], model: Model) -> np.ndarray:
    inputs = _inputs(figures(texts, model.weights, model.exceptions))
    return 1 / (1 + np.exp(-np.clip(inputs @ np.array(model.curve), -30, 30)))


def _counted(columns: str, of):
    """Rows ``(key, toxic, harmless)`` of a task's texts: how many of either kind ``of(texts, labels)`` found each key in."""
    def apply(batches):
        for part in in_slices(batches, "text", 20 * _SLICE):
            toxic, harmless = Counter(), Counter()
            for label, keys in of(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                (toxic if label else harmless).update(keys)
            keys = sorted({*toxic, *harmless})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                                              pa.array([harmless[k] for k in keys], pa.int64())], names=["key", "toxic", "harmless"])
    return apply, columns


def _pruned(rows: list) -> dict[str, float]:
    """Without beginnings that a longer entry with the same counts makes idle."""
    out: dict[str, float] = {}
    counts = {r["key"]: (r["t"], r["h"]) for r in rows}
    idle = {key[:k] for key, n in counts.items() for k in range(4, len(key)) if counts.get(key[:k]) == n}
    for r in rows:
        if r["key"] not in idle and len(out) < LEXICON:
            out[r["key"]] = float(r["w"])
    return out


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from rows with a label of 0 or 1 (others are left out); no rows: everything scores the same low value."""
    rows = labelled.select(sound(labelled, text).alias("text"), F.col(toxic).cast("int").alias("toxic")).where("text IS NOT NULL AND toxic IN (0, 1)")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / total)))
    rows = checkpointed(rows)
    base = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = base.get(1, 0), base.get(0, 0)
    if not bad or not good:
        rate = (bad + 0.1) / (bad + good + 2)
        return Model({}, (), (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))

    def words(texts, labels):
        for line, label in zip(fold(texts)[0].split("\n"), labels):
            yield label, _features(line)

    apply, schema = _counted("key string, toxic bigint, harmless bigint", words)
    counts = rows.mapInArrow(apply, schema).groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("harmless").alias("h"))
    odds = F.expr(f"ln((t + 0.5D) / {bad + 1}D) - ln((h + 0.5D) / {good + 1}D)")
    sure = (
        counts.where("t >= 2").withColumn("w", odds).withColumn("z", F.expr("w / sqrt(1 / (t + 0.5D) + 1 / (h + 0.5D))"))
        .where("w > 1.5D AND z > 2.2D").orderBy(F.desc("z"), "key").limit(4 * LEXICON)
    )
    weights = _pruned(sure.collect())

    def phrases(texts, labels):
        entries = _matcher(tuple(weights), ())
        for line, label in zip(fold(texts)[0].split("\n"), labels):
            found = set()
            for end, i in entries.iter(line) if len(entries) else ():
                start = end - len(tuple(weights)[i]) + 1
                stop = line.find(" ", start + 1)
                ahead = line.find(" ", stop + 1)
                if ahead > 0:
                    found.add(line[start:ahead + 1])
                back = line.rfind(" ", 0, start)
                if back >= 0 and start:
                    found.add(line[back:stop + 1])
            yield label, found

    apply, schema = _counted("key string, toxic bigint, harmless bigint", phrases)
    spare = rows.mapInArrow(apply, schema).groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("harmless").alias("h"))
    exceptions = tuple(r["key"] for r in spare.where("t = 0 AND h >= 4").orderBy(F.desc("h"), "key").limit(EXCEPTIONS).collect())

    def measured(batches):
        for part in in_slices(batches, "text", _SLICE):
            x = figures(part.column("text").to_pylist(), weights, exceptions)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), part.column("toxic")], names=["a", "b", "c", "y"])

    points = rows.mapInArrow(measured, "a double, b double, c double, y int").groupBy("a", "b", "c", "y").count().orderBy("a", "b", "c", "y").collect()
    x = np.repeat([[r["a"], r["b"], r["c"]] for r in points], [r["count"] for r in points], axis=0)
    y = np.repeat([float(r["y"]) for r in points], [r["count"] for r in points])
    return Model(weights, exceptions, _curve(x, y))


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in place of the text.

    A null text counts as empty, bytes that are no UTF-8 as U+FFFD.  Repeated rows come
    back repeated; columns with the names of the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text, "score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def apply(batches):
        for part in in_slices(batches, text, _SLICE):
            found = score(part.column(text).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    return docs.select(*(docs[f"`{c}`"] for c in kept), sound(docs, text).alias(text)).mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Learn from the labels of rows that are not held out, score every document.

    Documents without a label, with a null id or a repeated id are scored like
    any other; a label repeated for one id counts each time.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), "toxic").where(~held_out("doc_id"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), "text")
    model = fit(texts.join(known, "doc_id"))
    return predict(texts.withColumn("held_out", held_out()), model)
