"""The text operators as queries over the test tables: thin forms of the operators, whole tables, production parameters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeledger.llm import byte_bpe, divergence, embeddings, html_text, language, packing, quality, revisits, rollups, runs, secret_scan, simhash, toxicity
from tradeledger.llm.common import checkpointed, in_slices, sound, table
from tradeledger.sources.sinks import staging_path


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def capture_records(pages: DataFrame) -> DataFrame:
    """Web captures with the columns of ``revisits.RECORDS``, four per page.

    A page was fetched in full at a minute of its own; it was asked for again 30
    days later (entity tag), 60 days later (digest) and, before that, 30 days
    earlier, each time with the answer that nothing had changed.
    """
    fetched = pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("md5"), F.expr("1704067200 + page_id * 60").alias("t"))
    tag = "'\"' || left(md5, 16) || '\"'"
    date = lambda t: f"date_format(timestamp_seconds({t}), 'EEE, dd MMM yyyy HH:mm:ss') || ' GMT'"
    record = lambda n, kind, t, status, headers, digest: (
        f"named_struct('record_id', 'p' || page_id || '-{n}', 'kind', '{kind}', 'uri', url, 'date', timestamp_seconds({t}), 'status', {status}, "
        f"'headers', filter(array({', '.join(f'''named_struct('name', '{k}', 'value', {v})''' for k, v in headers)}), h -> h.value IS NOT NULL), 'digest', {digest})")
    day = 86400
    return fetched.select(F.inline(F.expr("array(" + ", ".join([
        record(0, "response", "t", 200, [("Date", date("t")), ("ETag", tag), ("Content-Type", "'text/html'"), ("Cache-Control", "'max-age=60'")], "md5"),
        record(1, "revisit", f"t + {30 * day}", 304, [("Date", date(f"t + {30 * day}")), ("etag", f"'W/' || {tag}"), ("Content-Length", "'0'"), ("cache-control", "'max-age=600'")], "CAST(NULL AS STRING)"),
        record(2, "revisit", f"t + {60 * day}", 304, [("Date", date(f"t + {60 * day}"))], "md5"),
        record(3, "revisit", f"t - {30 * day}", 304, [("Date", date(f"t - {30 * day}")), ("Expires", "'0'")], "md5"),
    ]) + ")")))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(capture_records(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "url", F.unix_timestamp("date").alias("asked_at"), "source_id", F.unix_timestamp("source_date").alias("fetched_at"), "outcome",
        F.expr("array_join(transform(headers, h -> lower(h.name) || ': ' || h.value), '\\n')").alias("headers"), "digest")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(packing.packed(table(spark, sf_dir, "documents"), added=True))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judged(docs.select("doc_id", "text"), quality.fit(docs, labels)).drop("text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, source, lang, n_words, n_tokens, n_once``: tokens of each text, and of the text without its repeated lines."""
    def apply(batches):
        encode = lambda text: len(packing.encoder(name).plain(text)) // 4
        for part in in_slices(batches, "text", 4_000_000):
            rows = []
            for text in part.column("text").to_pylist():
                lines = (text or "").split("\n")
                once = list(dict.fromkeys(lines))
                n = encode(text or "")
                rows.append((len((text or "").split()), n, n if len(once) == len(lines) else encode("\n".join(once))))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), *columns],
                                             names=["doc_id", "source", "lang", "n_words", "n_tokens", "n_once"])

    return docs.select("doc_id", "source", "lang", sound(docs, "text").alias("text")).mapInArrow(
        apply, "doc_id bigint, source string, lang string, n_words bigint, n_tokens bigint, n_once bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the documents: all are counted, those with repeated lines are counted anew without these
    (delivered twice), those of fewer than 20 words are deleted."""
    counts = checkpointed(token_counts(table(spark, sf_dir, "documents")))
    base = staging_path(spark, "token_counts")
    change = lambda op, n, where: counts.where(where).selectExpr(
        "doc_id", "1L AS seq", f"'{op}' AS op", "source", "lang", "'byte_bpe_50k' AS version", f"{n} AS n_tokens")
    rollups.apply_batch(base, 1, change("insert", "n_tokens", "true"))
    rollups.apply_batch(base, 2, change("revise", "n_once", "n_once <> n_tokens"))
    rollups.apply_batch(base, 2, change("revise", "n_once", "n_once <> n_tokens"))
    rollups.apply_batch(base, 3, change("delete", "n_tokens", "n_words < 20"))
    return rollups.totals(spark, base)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [r.kind for r in secret_scan.BASE]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base),
        F.sha2(secret_scan.joined(of(*base)), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text, by its id's CRC-32, repeats a part of itself to its end.  A null id changes nothing."""
    return (
        docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
        .withColumn("w", F.expr(r"CASE WHEN h % 10 = 0 THEN filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '') END"))
        .withColumn("n", F.expr("nullif(size(w), 0)")).withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.expr("CAST(g % n AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
        .select("doc_id", F.expr("CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' ') ELSE text END").alias("text"))
    )


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_simhash, op3_embeddings, op4_toxicity, op5_revisits, op6_html, op7_packing, op8_quality, op9_byte_bpe, op10_token_counts,
    op11_secrets, op12_runs, op13_divergence)}
