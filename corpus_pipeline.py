"""From raw documents to packed training windows, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and its rows are written before the
next one reads them.  All stages but the last return the columns they got.
Nulls, empty texts, repeated rows and empty tables have defined results:

* ``language``: texts that are null, or have no letters, or fit no language
  better than the next, go.  Without labelled rows nothing can be told apart,
  and everything goes.
* ``quality``: texts that fail the rules or the likelihood threshold go.
* ``near_duplicates``: texts whose fingerprints (three-word shingles) differ in two
  bits at most are linked; of each class one document stays, that with the
  smallest id; of a class without ids one of its rows.  Repeated rows are one
  class; rows of different classes with one id all stay.
* ``packing``: one row per piece of a document in a window, with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeledger.llm import language as lang
from tradeledger.llm import packing as pack
from tradeledger.llm import quality as qual
from tradeledger.llm import simhash
from tradeledger.llm.common import importable, table
from tradeledger.sources.sinks import staging_path

MIN_MARGIN = 0.01   # how many fewer bits the best language needs than the next, at least

#: Language models, hashed likelihoods, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    model = lang.fit(docs.where(~lang.held_out()))
    found = lang.predict(docs.select(*docs.columns), model)
    return found.where(f"lang_pred <> 'und' AND score >= {MIN_MARGIN}").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = qual.fit(docs, table(spark, sf_dir, "labels"))
    return qual.judged(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return simhash.representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return pack.packed(docs, added=True).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, f"corpus_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
