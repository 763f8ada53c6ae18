"""Every operator and stage over rows with odd bytes, clashing names, nulls and repeats."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from text_helpers import documents, package  # noqa: F401
from tradeledger.llm import byte_bpe, divergence, html_text, language, packing, quality, registered, runs, secret_scan, simhash, toxicity

CLASHES = ["_w", "_p", "_e", "_words", "_lines", "_starts", "_sorted", "_text", "_read", "fp", "row", "t", "number", "class", "n", "ids", "shard", "leaf", "at", "spans", "bucket", "key", "_node", "_first"]


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    made = base.union(base.limit(5)).union(base.limit(3).withColumn("text", F.lit(None).cast("string"))).union(base.limit(3).withColumn("text", F.lit(""))).union(
        base.limit(4).withColumn("text", F.expr("concat('bad ', cast(X'C328FF' AS string), ' bytes here, ', text)"))).union(base.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    for n in CLASHES:
        made = made.withColumn(n, F.lit(f"own {n}"))
    return made.repartition(3).cache()


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


OPERATORS = {
    "language": lambda s, d: language.predict(d, language.fit(d)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.predict(d, toxicity.fit(d.join(labels(s), "doc_id"))),
    "html": lambda s, d: html_text.main_text(d, "text", html_text.fit(s.read.parquet(f"{SMALL}/pages.parquet"))),
    "quality": lambda s, d: quality.judged(d, quality.fit(d, labels(s))),
    "byte_bpe": lambda s, d: byte_bpe.encoded(d),
    "token_counts": lambda s, d: registered.token_counts(d),
    "secrets": lambda s, d: secret_scan.scan(d),
    "runs": lambda s, d: runs.periodic_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, odd, name):
    made = OPERATORS[name](spark, odd)
    assert made.count() == odd.count() == len(made.collect())
    for n in set(made.columns) & set(CLASHES) - {"spans", "class"}:
        assert [r[0] for r in made.select(n).distinct().collect()] == [f"own {n}"], n


def test_packing_and_audit(spark, odd):
    assert packing.packed(odd).agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == odd.count()
    assert divergence.audit(odd).count() > 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, odd, stage):
    made = corpus_pipeline.STAGES[stage][1](spark, odd, SMALL)
    rows = made.collect()
    assert rows
    if stage < 3:
        assert made.columns == odd.columns
        assert all(r[n] == f"own {n}" for r in rows for n in CLASHES)
