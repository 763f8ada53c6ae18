"""Quality rules and a hashed n-gram likelihood ratio, in built-in functions only.

* Rules: counts of words, symbols, repeated lines and repeated 8-word windows.
* Model: words and word pairs are hashed into ``2 ** BITS`` buckets each.  Two
  multinomials are counted over the buckets, one of trusted texts, one of the
  whole raw corpus.  A text's score is the mean log-ratio of its words and
  pairs, so length does not matter by itself.
* Threshold: the ``TOLERANCE`` quantile of the trusted texts' own scores, less
  ``SLACK``.  Every text is held against it; nothing is drawn at random.

The corpus and the trusted texts are counted whole.  The model is two times
``2 ** BITS`` numbers whatever the corpus, and travels as a constant of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tradeledger.sources.sinks import staged

BITS = 13
TOLERANCE = 0.005
SLACK = 0.05
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30       # per cent of the words

_SPACE = " \t\n\x0b\x0c\r"


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with hashes of words (``_w``), word pairs (``_p``) and 8-word windows (``_e``), and ``_words`` themselves.

    A null text has no words.
    """
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return (
        docs.withColumn("_words", words)
        .withColumn("_w", F.expr("transform(_words, x -> xxhash64(x))"))
        .withColumn("_p", F.expr("transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1)))"))
        .withColumn("_q", F.expr("transform(_p, (x, i) -> xxhash64(x, get(_p, i + 2)))"))
        .withColumn("_e", F.expr(f"slice(transform(_q, (x, i) -> xxhash64(x, get(_q, i + 4))), 1, greatest(size(_q) - {WINDOW - 1}, 0))"))
        .withColumn("_p", F.expr("slice(_p, 1, greatest(size(_p) - 1, 0))"))
        .drop("_q")
    )


def rules(worded: DataFrame, text: str = "text") -> DataFrame:
    """``worded`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.expr(f"filter(split(coalesce(`{text}`, ''), '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')")
    # Windows found twice lie side by side when sorted; where they start, in order, tells how many words they cover.
    starts = F.expr(
        "array_sort(filter(transform(_sorted, (x, i) -> IF(x.h = get(_sorted, i - 1).h OR x.h = get(_sorted, i + 1).h, x.i, NULL)), x -> x IS NOT NULL))")
    return (
        worded
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.char_length(F.concat_ws("", "_words")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", F.expr("size(_lines) - size(array_distinct(_lines))").cast("bigint"))
        .withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_e)) < size(_e) THEN array_sort(transform(_e, (x, i) -> struct(x AS h, i AS i))) END"))
        .withColumn("_starts", starts)
        .withColumn("n_repeat_words", F.expr(
            f"coalesce(aggregate(_starts, named_struct('n', 0L, 'end', 0L), (a, x) -> named_struct('n', a.n + x + {WINDOW}L - greatest(a.end, CAST(x AS BIGINT)), "
            f"'end', x + {WINDOW}L), a -> a.n), 0L)"))
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words"))
        .drop("_lines", "_sorted", "_starts")
    )


def _buckets(bits: int) -> str:
    return f"concat(transform(_w, x -> CAST(x & {(1 << bits) - 1} AS INT)), transform(_p, x -> CAST((x & {(1 << bits) - 1}) + {1 << bits} AS INT)))"


def _counted(worded: DataFrame, bits: int) -> dict[int, int]:
    """Rows per bucket; at most ``2 ** (bits + 1)`` numbers come back."""
    counts = worded.select(F.explode(F.expr(_buckets(bits))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


@dataclass(frozen=True)
class Model:
    """Log-ratio by bucket, words first; texts at or above ``threshold`` are kept."""

    ratios: tuple[float, ...]
    bits: int
    threshold: float


def _ratios(trusted: dict[int, int], raw: dict[int, int], bits: int) -> tuple[float, ...]:
    out: list[float] = []
    for base in (0, 1 << bits):
        span = range(base, base + (1 << bits))
        t, r = sum(trusted.get(b, 0) for b in span), sum(raw.get(b, 0) for b in span)
        # The trusted counts lean on the raw ones, so a bucket that few trusted texts meet says little.
        out += [round(math.log((trusted.get(b, 0) + 100 * share) / (t + 100) / share), 4)
                for b in span for share in [(raw.get(b, 0) + 0.5) / (r + 0.5 * (1 << bits))]]
    return tuple(out)


def score(model: Model) -> Column:
    """Mean log-ratio of the words and pairs of ``with_words`` rows; 0 without words."""
    # Cast from one literal, the table is folded into a constant array when the plan is optimised.
    ratios = "CAST(split('" + ",".join(map(str, model.ratios)) + "', ',') AS ARRAY<DOUBLE>)"
    mask, half = (1 << model.bits) - 1, 1 << model.bits
    total = (f"aggregate(_w, 0D, (a, x) -> a + get({ratios}, CAST(x & {mask} AS INT))) "
             f"+ aggregate(_p, 0D, (a, x) -> a + get({ratios}, CAST(x & {mask} AS INT) + {half}))")
    return F.expr(f"({total}) / greatest(size(_w) + size(_p), 1)")


_MARKS = 18     # ``2 ** 18`` longs of 64 marks are sent to the tasks, whatever the number of ids


def _perhaps(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``ids`` (``_id``), told before anything moves; all others stay."""
    mark = lambda n: F.pmod(F.xxhash64(F.col(n)), F.lit(64 << _MARKS))
    marks = ids.select(mark("_id").alias("_m")).groupBy(F.expr("_m div 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_m % 64 AS INT))")).alias("_bits"))
    met = rows.withColumn("_m", mark(column)).withColumn("_word", F.expr("_m div 64")).join(F.broadcast(marks), "_word")
    return met.where("getbit(_bits, CAST(_m % 64 AS INT)) = 1").select(*rows.columns)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> Model:
    """Count the corpus, and all texts whose ``labels.quality`` is 1; without any, every ratio is 0 and every text passes.

    The trusted texts are written to the shared folder once: the counts and the threshold read them there.
    """
    good = labels.where("quality = 1").select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").distinct()
    worded = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    # An inner join, because a semi-join would be moved below the marks; hashed, so that the texts that are left are not sorted.
    trusted = _perhaps(worded, "_id", good).join(good.hint("shuffle_hash"), "_id").select("text")
    chosen = with_words(staged(trusted, "trusted")).select("_w", "_p")
    wanted = _counted(chosen, bits)
    if not wanted:
        return Model((0.0,) * (2 << bits), bits, 0.0)
    model = Model(_ratios(wanted, _counted(with_words(docs.select(text), text), bits), bits), bits, 0.0)
    low = chosen.where(f"size(_w) >= {MIN_WORDS}").agg(F.percentile_approx(score(model), TOLERANCE, 10_000).alias("low")).first()["low"]
    return Model(model.ratios, bits, round((low or 0.0) - SLACK, 6))


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``rules``, ``score`` and ``kept``.

    Columns of these names are replaced, all others stay, whatever their names; no row
    is lost, repeated ones neither.  A null text has no words and fails the rules.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    plain = docs.drop(*new)
    held = plain.select(F.struct(*(plain[f"`{c}`"] for c in plain.columns)).alias("row"), docs[f"`{text}`"].alias("text"))
    made = (
        rules(with_words(held))
        .withColumn("score", score(model))
        .withColumn("kept", F.expr(f"NOT base_failed AND score >= {model.threshold}D"))
    )
    # Unpacked from a list of one, so that a filter on ``kept`` stays above this: pushed down it would be
    # written out in terms of the text, and every list above be computed again for each of its elements.
    return made.select("row", F.inline(F.array(F.struct(*new)))).select(*(F.col(f"row.`{c}`") for c in plain.columns), *new)
