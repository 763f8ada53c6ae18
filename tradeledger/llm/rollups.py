"""Token counts kept up to date by signed changes.

Changes come in numbered batches.  A batch is turned into signed rows: a new
document adds its count, a deleted one takes its count away, a revised one does
both, also where it moves to another source or language.  The rows of a batch
are summed by source, language and tokenizer version, and the totals of the
whole are the sums over batches.

Folders below ``base``:

* ``changes/batch=N``: signed rows of a batch, by document;
* ``totals/batch=N``: their sums;
* ``commits/batch=N``: written last.  Only committed batches are read, so a
  batch that failed on its way is simply written again, and one that was
  committed is not applied a second time;
* ``folded/upto=N``: what the batches up to ``N`` amount to (``folds/upto=N`` is
  written last), so that reading
  does not slow down with the number of batches.

Batches are applied one after another, by one writer.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

CHANGES = "doc_id bigint, seq bigint, op string, source string, lang string, version string, n_tokens bigint"
_SIGNED = "doc_id bigint, version string, source string, lang string, docs bigint, tokens bigint"
_TOTALS = "source string, lang string, version string, docs bigint, tokens bigint"
_KEYS = ["source", "lang", "version"]


def _numbers(spark: SparkSession, base: str, folder: str, name: str) -> list[int]:
    """Numbers of the committed batches or folds."""
    try:
        return sorted(r[name] for r in spark.read.schema(f"{name} bigint").parquet(f"{base}/{folder}").select(name).distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _parts(spark: SparkSession, base: str) -> tuple[int | None, list[int]]:
    """The newest fold, and the committed batches after it."""
    folds = _numbers(spark, base, "folds", "upto")
    last = folds[-1] if folds else None
    return last, [b for b in _numbers(spark, base, "commits", "batch") if last is None or b > last]


def _read(spark: SparkSession, base: str, kind: str, schema: str) -> DataFrame:
    fold, batches = _parts(spark, base)
    paths = [f"{base}/{kind}/batch={b}" for b in batches]
    paths += [f"{base}/folded/upto={fold}/{kind}"] if fold is not None else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def totals(spark: SparkSession, base: str) -> DataFrame:
    """``source, lang, version, docs, tokens`` over all committed batches; groups without documents are left out."""
    summed = _read(spark, base, "totals", _TOTALS).groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return summed.where("docs <> 0 OR tokens <> 0")


def current(spark: SparkSession, base: str) -> DataFrame:
    """``doc_id, version, source, lang, docs, tokens`` of the documents that are there."""
    rows = _read(spark, base, "changes", _SIGNED)
    return rows.groupBy("doc_id", "version", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


def signed(changes: DataFrame, held: DataFrame) -> DataFrame:
    """The signed rows that turn ``held`` (as of ``current``) into what ``changes`` ask for.

    The change with the greatest ``seq`` of a document and version counts; of
    several with that ``seq`` one is chosen by its other columns.  ``insert``
    and ``revise`` set a count, whether there was one or not; ``delete`` of what
    is not there does nothing.  Changes without document or version, or with
    another ``op``, are left out; a count of null is 0.  Null sources and
    languages are groups of their own.
    """
    asked = changes.where("doc_id IS NOT NULL AND version IS NOT NULL AND lower(op) IN ('insert', 'revise', 'delete')")
    last = asked.groupBy("doc_id", "version").agg(
        F.max(F.struct("seq", F.lower("op").alias("op"), "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))).alias("c"))
    add = last.where("c.op <> 'delete'").select("doc_id", "version", "c.source", "c.lang", F.lit(1).cast("bigint").alias("docs"), F.col("c.n").alias("tokens"))
    take = held.join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi").select(
        "doc_id", "version", "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
    rows = add.union(take).groupBy("doc_id", "version", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return rows.where("docs <> 0 OR tokens <> 0")


def apply_batch(base: str, batch: int, changes: DataFrame) -> bool:
    """Apply a batch; False, and no change, if it was applied before or comes before one that was folded."""
    spark = changes.sparkSession
    fold, done = _parts(spark, base)
    if batch in done or (fold is not None and batch <= fold):
        return False
    held = current(spark, base)
    signed(changes, held).write.mode("overwrite").parquet(f"{base}/changes/batch={batch}")
    rows = spark.read.schema(_SIGNED).parquet(f"{base}/changes/batch={batch}")
    rows.groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{base}/totals/batch={batch}")
    spark.range(1).selectExpr("id").coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/batch={batch}")
    return True


def fold(spark: SparkSession, base: str) -> int | None:
    """Write what the committed batches amount to as one; returns the last batch folded.  Older files stay for readers that use them."""
    _, batches = _parts(spark, base)
    if not batches:
        return None
    upto = batches[-1]
    current(spark, base).select("doc_id", "version", "source", "lang", "docs", "tokens").write.mode("overwrite").parquet(f"{base}/folded/upto={upto}/changes")
    totals(spark, base).write.mode("overwrite").parquet(f"{base}/folded/upto={upto}/totals")
    spark.range(1).selectExpr("id").coalesce(1).write.mode("overwrite").parquet(f"{base}/folds/upto={upto}")
    return upto
