"""How far each source's word use lies from the other sources of its language, and by which terms.

Terms are runs of ASCII letters and non-ASCII characters, A-Z folded.  A language
keeps those that ``LEAST`` of its documents hold.  Every (language, source) group
and every language gives each kept term the smoothed share
``p = 1 + floor(SCALE * (count + 2) / (total + 2 * V))``; two shares differ by
``f = floor((p - q)^2 / (p + q))``.

Neither report evaluates ``f`` per term:

* **Terms of a group.**  Terms are grouped into cells by (group count, language
  count).  ``f`` is evaluated once per cell, cells of equal value are merged, and
  a merged value's rank follows from how many terms lie above it.  Only values
  that start within the ranks asked for are expanded into their terms, in UTF-8
  order.
* **Pairs of sources.**  Only pairs of sources that both have a term are formed,
  from its profile of (source, count).  Each adds what ``f`` of the two counts has
  over ``f`` with a zero on one side; these come from the sources' own histograms,
  and terms that neither has from V.

Tasks count their own rows before anything is shuffled, in tables of bounded
size.  A term's profile has as many entries as its language has sources, which is
also how long a row of the pair report is; nothing grows with documents in one
task.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeledger.llm.common import checkpointed, in_slices

LEAST = 10          # documents of its language that a kept term is in
TOP = 10            # ranks of the term report
SCALE = 1_000_000_000

_HELD = 300_000     # counts that a task holds before it sends them on

#: Bytes of text to bytes of terms: A-Z folded, other ASCII characters to blanks.
_FOLDED = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """All terms of a text (UTF-8) in order, repeats included."""
    return text.translate(_FOLDED).split()


def _partial(batches):
    """``lang, source, term, n, df`` of the rows ``lang, source, text`` of a task, as often as its tables fill up."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def emit():
        for (lang, source), (uses, docs) in held.items():
            found = list(uses)
            for start in range(0, len(found), 100_000):
                part = found[start:start + 100_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([uses[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    for batch in batches:
        for part in in_slices([batch], "text", 4_000_000):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = terms(text.encode())
                uses, docs = held[lang, source]
                uses.update(found)
                docs.update(set(found))
            if sum(len(uses) for uses, _ in held.values()) > _HELD:
                yield from emit()
    yield from emit()


def _share(count: str, total: str, v: str) -> Column:
    """``p``; counts are decimals on the way, so that sums of 100 TB do not overflow."""
    return F.expr(f"1L + ({SCALE} * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {v} AS DECIMAL(20, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """``lang, term, total, profile``: kept terms with their count in the language and ``profile`` = [(source, n)] of its sources, in order."""
    rows = docs.select(*(F.make_valid_utf8(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    # One shuffle serves both groupings.
    uses = rows.mapInArrow(_partial, "lang string, source string, term string, n bigint, df bigint").repartition("lang", "term")
    return (
        uses.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("profile"))
        .where(F.col("df") >= least).drop("df")
    )


def _evaluated(cells: DataFrame) -> DataFrame:
    """Cells with ``f`` of the group's share and the language's."""
    return cells.withColumn("p", _share("n_a", "total_a", "v")).withColumn("q", _share("n_b", "total_b", "v")).withColumn("f", _f("p", "q"))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language.

    With ``p0`` for the share of a term that a source lacks, a term of counts above
    zero on both sides adds ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)`` to what the
    histograms of the two sources give.
    """
    shares = groups.where("v > 0").withColumn("none", F.lit(0)).withColumn("p0", _share("none", "total", "v")).select("lang", "source", "total", "v", "p0")
    uses = kept.select("lang", "term", F.explode("profile").alias("g")).select("lang", "term", "g.source", "g.n")
    profiles = (
        uses.join(shares, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
        .groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("profile"))
    )
    gain = " ".join(f"{sign} (({a} - {b}) * ({a} - {b})) div ({a} + {b})" for sign, a, b in
                    (("", "a.p", "b.p"), ("-", "a.p", "b.p0"), ("-", "a.p0", "b.p"), ("+", "a.p0", "b.p0")))
    both = (
        profiles.select("lang", "profile", F.explode("profile").alias("a")).select("lang", "a", F.explode("profile").alias("b")).where("a.source <> b.source")
        .groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(F.expr(gain)).alias("value"))
    )
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    mine = shares.select("lang", "source", "v", "p0")
    yours = shares.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    known = pairs.join(mine, ["lang", "source"], "left").join(yours, ["lang", "item"], "left")
    bare = "((p0 - q0) * (p0 - q0)) div (p0 + q0)"
    own = uses.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(shares, ["lang", "source"]).select(
        "lang", "source", _share("n", "total", "v").alias("p"), "m")
    here = known.join(own, ["lang", "source"]).select("lang", "source", "item", F.expr(f"m * (((p - q0) * (p - q0)) div (p + q0) - {bare})").alias("value"))
    there = known.join(own.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", F.expr(f"m * (((p - p0) * (p - p0)) div (p + p0) - {bare})").alias("value"))
    base = known.select("lang", "source", "item", F.expr(f"coalesce(v * ({bare}), 0L)").alias("value"))
    return base.union(here).union(there).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _leading(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the terms that a source uses more than its language, the first ``top``."""
    uses = kept.select("lang", "term", F.col("total").alias("n_b"), F.explode("profile").alias("g")).select(
        "lang", F.col("g.source").alias("source"), "term", F.col("g.n").alias("n_a"), "n_b")
    cell = ["lang", "source", "n_a", "n_b"]
    sizes = groups.select("lang", "source", F.col("total").alias("total_a"), "v").join(langs.select("lang", F.col("total").alias("total_b")), "lang")
    cells = _evaluated(uses.groupBy(*cell).agg(F.count("*").alias("m")).join(sizes, ["lang", "source"])).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("f"))
    # At most ``top`` values of a group can matter: each stands for one term at least.
    values = cells.groupBy("lang", "source", "f").agg(F.sum("m").alias("m")).withColumn("place", F.row_number().over(best)).where(f"place <= {top}")
    above = F.coalesce(F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("above", above).where(f"above < {top}").select("lang", "source", "f", "above")
    found = uses.join(cells.select(*cell, "f").join(values, ["lang", "source", "f"]), cell)
    within = Window.partitionBy("lang", "source", "f").orderBy("term")
    listed = found.withColumn("k", F.row_number().over(within)).where(f"k <= {top}").withColumn("rank", F.expr("CAST(above + k AS INT)"))
    return listed.where(f"rank <= {top}").select("lang", "source", F.col("term").alias("item"), F.col("f").alias("value"), "rank")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group its distance to each other source (``pair``) and its leading terms (``term``).

    Null texts, languages and sources count as empty strings.  Repeated rows count
    each time.  Ties rank by the item's UTF-8 order.  A language without kept
    terms has pairs of value 0; one with a single source has none; an empty table
    gives no rows.  Other columns of ``docs`` play no part, whatever their names.
    """
    seen = docs.select(*(F.make_valid_utf8(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    kept = checkpointed(counted(docs, text, lang, source, least))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("total"), F.count("*").alias("v"))
    totals = kept.select("lang", F.explode("profile").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(F.sum("g.n").alias("total"))
    groups = checkpointed(
        seen.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    leading = _leading(kept, groups, langs, top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(leading.select(columns))
