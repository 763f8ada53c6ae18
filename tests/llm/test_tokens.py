"""BPE against tiktoken and tokenizers, packing, revisits and the pipeline."""

import datetime as dt
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from test_duplicates import plain_fingerprint
from text_helpers import documents, package  # noqa: F401
from tradeledger.llm import byte_bpe, language, packing, quality, registered, revisits


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_tiktokens(spark, name):
    coder, _ = byte_bpe.coder(name)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "aa", "the", "e", "é", "ß", " ", "  ", "\n", "1", "23", "!", "…", "漢", "字", "😀", "\x00", "<|endoftext|>", "Ab", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 30_000, "ab" * 9000, " " * 9000 + "x", "=-" * 4000]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in texts:
        ids = coder.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


def test_a_full_memo_forgets_and_stays_right():
    memo = byte_bpe.Memo(lambda k: [k], 10)
    rng = random.Random(2)
    for _ in range(2000):
        k = rng.randrange(60)
        assert memo[k] == [k] and len(memo) <= 10 and len(memo.old) <= 10


def test_digests_of_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (2, "two words"), (None, "é" * 3000), (3, "x y " * 40_000)]
    got = byte_bpe.encoded(documents(rows).select("doc_id", "text", F.lit(1).alias("n_tokens"))).collect()
    plain = packing._encoding("byte_bpe_50k.tiktoken")
    want = sorted((str(i), len(ids := plain.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    ids = byte_bpe.encoded(documents(rows).select("doc_id", "text"), lists=True)
    assert sorted(r.bytes.decode() for r in byte_bpe.decoded(ids).collect()) == sorted(t or "" for _, t in rows)
    assert byte_bpe.encoded(documents([])).count() == 0


def whole(pieces, texts, window=1024):
    """Every id of every document in one piece, every sequence without gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(pieces, key=lambda r: r.start):
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == at[r.doc_id] and r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    full = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert all(n <= window for n in full.values())
    return full


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    full = whole(registered.op7_packing(spark, SMALL).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert sum(n < 1024 for n in full.values()) <= 1


def test_packing_of_odd_rows(spark, documents):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "x", 5: "<|endoftext|>"}
    docs = documents(texts.items()).withColumn("offset", F.lit("x")).repartition(3)
    whole(registered.with_crc(packing.packed(docs)).collect(), texts)
    assert packing.packed(documents([(7, "a"), (7, "a"), (None, "b")])).count() == 3
    assert packing.packed(docs.limit(0)).count() == 0


def test_neighbours_by_bm25():
    rng = np.random.default_rng(3)
    common = np.arange(1, 5)
    topics = [np.concatenate([rng.integers(100 * t, 100 * t + 20, 200), common]).astype("<u4") for t in (1, 2, 1, 2, 3, 1, 4, 5, 6, 7)]
    scores = packing.Index(topics).scores(0)
    assert set(np.argsort(-scores)[:3].tolist()) == {0, 2, 5} and scores[4] == 0
    pieces = packing.pack(topics, 512)
    first = [p[0] for p in pieces if p[3] == 0]
    assert first[0] == 0 and set(first) == {0, 2, 5}


def test_neighbours_far_apart_in_the_table(spark, documents):
    """Forty topics in turn, shards of 48 documents: file order would leave about one document of a topic in a shard."""
    rng = random.Random(12)
    docs = documents([(i, " ".join(f"{chr(97 + i % 40 % 26)}{'qxz'[i % 40 // 26]}{rng.randrange(40)}" for _ in range(100))) for i in range(2000)])
    windows = {}
    for r in packing.packed(docs.repartitionByRange(4, "doc_id"), shard=48).collect():
        windows.setdefault(r.sequence_id, []).append((r.offset, r.doc_id % 40))
    pairs = [a[1] == b[1] for w in windows.values() for a, b in zip(sorted(w), sorted(w)[1:])]
    assert len(pairs) > 1000 and sum(pairs) > 0.7 * len(pairs)


def test_counts_are_of_the_whole_table(spark):
    rows = [[1, 2, 2, 0], [2, 0], [70_000, 2, 0], [0], [5, 0]] * 3
    staged = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(rows)], "n long, ids binary").repartition(4)
    corpus = packing._corpus(staged)
    df = np.bincount([t for x in rows for t in set(x)])
    assert corpus.n == 15 and corpus.mean == sum(map(len, rows)) / 15
    assert np.allclose(corpus.idf, np.log(np.maximum((15 - df + 0.5) / (df + 0.5), 1)))
    assert packing.Index([np.array(x, "<u4") for x in rows[:2]], corpus).scores(0)[0] > 0 == packing.Index([np.array([2, 0], "<u4")] * 2).scores(0)[0]


def test_added_tokens_are_one_id(spark, documents, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "a<|endoftext|>b", 2: "<|endoftext|>", 3: "x <|endoftext|><|endoftext|> y\n", 4: "no <|endoftext| >", 5: "é <|endoftext|>", 6: None}
    docs = documents(texts.items())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(ids := [*tokenizer.encode(t or "").ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts.items()}
    assert want[1][0] == 4
    for rows in (registered.op7_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows.collect()} == want


def captures():
    rng, rows, start = random.Random(3), [], dt.datetime(2024, 1, 1)
    for i in range(1500):
        uri = rng.choice(["http://www.a.com/x/", "https://a.com/x?utm_source=1#f", "A.com:443/x", "http://b.com/?b=2&a=1", "http://b.com?a=1&b=2", None])
        headers = [("ETag", rng.choice(['"1"', 'W/"1"', '"2"']))] * (rng.random() < 0.6) + [("Date", str(i)), ("Content-Length", str(i)), ("X", None)]
        rows.append((f"r{i:05d}", rng.choice(["response", "revisit", "response", "request"]), uri, start + dt.timedelta(seconds=rng.randint(0, 500)) if i % 50 else None,
                     rng.choice([200, 200, 404, None]), headers if i % 40 else None, rng.choice(["d1", "d2", None])))
    return rows


def plain_resolve(rows):
    page = lambda uri: None if uri is None else "a.com/x" if "a.com" in uri.lower() else "b.com?a=1&b=2"
    value = lambda headers, name: next((v for k, v in reversed(headers or []) if k.lower() == name and v is not None), None)
    out = {}
    for i, kind, uri, date, _, headers, digest in rows:
        if kind != "revisit":
            continue
        old = max(((r[3], r[0], r) for r in rows if r[1] == "response" and r[4] == 200 and uri and date and r[3] and r[3] < date and page(r[2]) == page(uri)), default=None)
        if old is None:
            out[i] = (None, "missing", digest, headers or [])
            continue
        old, headers = old[2], headers or []
        pairs = [tuple((value(h, "etag") or "").removeprefix("W/") for h in (headers, old[5])), (digest, old[6])]
        checks = [a == b for a, b in pairs if a and b]
        outcome = "unchecked" if not checks else "resolved" if all(checks) else "changed"
        if outcome == "resolved":
            new = [h for h in headers if h[0].lower() in revisits.RENEWED]
            headers = [h for h in old[5] or [] if h[0].lower() not in {k.lower() for k, _ in new}] + new
        out[i] = (old[0], outcome, old[6] or digest, headers)
    return out


@pytest.mark.parametrize("hot_rows", [2_000_000, 40])
def test_revisits_are_brute_force(spark, hot_rows):
    rows = captures()
    frame = spark.createDataFrame(rows, revisits.RECORDS).withColumn("source", F.lit(1))
    got = {r.record_id: (r.source_id, r.outcome, r.digest, [tuple(h) for h in r.headers]) for r in revisits.resolve(frame, hot_rows).collect()}
    want = plain_resolve(rows)
    assert got == want and len({o for _, o, _, _ in want.values()}) == 4
    assert revisits.resolve(frame.limit(0)).count() == 0
    assert revisits.resolve(frame.limit(30).union(frame.limit(30))).count() == 2 * revisits.resolve(frame.limit(30)).count()


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(documents([(None, None), (9000, ""), (None, "123"), (9001, "x")]))
    a = corpus_pipeline.language(spark, docs, SMALL)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    kept = {i for i, (p, s) in pred.items() if p != "und" and s >= corpus_pipeline.MIN_MARGIN}
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == kept
    b = corpus_pipeline.quality(spark, a, SMALL)
    model = quality.fit(a, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert b.columns == docs.columns and sorted(map(str, b.collect())) == sorted(map(str, quality.judged(a, model).where("kept").select(*docs.columns).collect()))
    extra = documents([(None, "no id here " * 30), (None, "no id here " * 30), (1_000_001, "again and again " * 9), (1_000_001, "again and again " * 9)])
    c = corpus_pipeline.near_duplicates(spark, b.unionByName(extra), SMALL)
    assert c.columns == docs.columns
    rows = sorted({(r.doc_id is None, r.doc_id or 0, plain_fingerprint(r.text)) for r in b.unionByName(extra).collect()})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][2] ^ rows[j][2]).bit_count() <= 2:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in c.collect()) == sorted(rows[g][:2] for g in set(group))
    named = c.where("doc_id IS NOT NULL")
    whole(corpus_pipeline.packing(spark, named, SMALL).collect(), {r.doc_id: r.text for r in named.collect()})


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_stages_run_over_the_documents(spark):
    assert corpus_pipeline.run(spark, SMALL).agg(F.countDistinct("doc_id")).first()[0] > 50
