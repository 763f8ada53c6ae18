"""Secret scans, periodic runs and the divergence audit against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from text_helpers import documents, package  # noqa: F401
from tradeledger.llm import divergence, registered, runs, secret_scan

SPACE = r"[^\x20\x09-\x0D]+"


def plain_secrets(text, rules=secret_scan.RULES):
    found = [(m.start(), n, m.end(), r.kind) for n, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m.group(r.part)) >= r.least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def secret_texts():
    rng = random.Random(1)
    parts = ["token", "secret", "passWord", "PASSWD", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "api_key", "ApiKey", "é", "😀", "\n", "0123456789abcdef", "deadbeef",
             "-----BEGIN RSA PRIVATE KEY-----", "abc/+=", "ghp_" + "a" * 36, "xoxb-1234567890", "sk_live_" + "a" * 16, "eyJabc.eyJdef.ghi", "http://user:pa@h", "AIza" + "x" * 35, "abcd", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(500)] + [
        None, "", "token=token: abcdefgh", "token=abcdef " * 20_000, "ToKEn = 'KKabcdef'", " " * 300_000, "İtoken=abcdefg"]


def test_secrets_are_brute_force(spark, documents):
    texts = secret_texts()
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3])] + [(10_000 + i, texts[5]) for i in range(200)]
    frame = documents(rows).withColumn("spans", F.lit(1)).withColumn("rules", F.lit("x")).withColumn("number", F.lit(2)).withColumn("t", F.lit(3)).withColumn("row", F.lit(4))
    found = secret_scan.scan(frame.repartition(5))
    assert sorted(found.columns) == sorted(frame.columns)
    got = sorted((str(r.doc_id), r.s, r.rules, r.number, r.t, r.row) for r in found.withColumn("s", secret_scan.joined(F.col("spans"))).collect())
    assert got == sorted((str(i), plain_secrets(t), "x", 2, 3, 4) for i, t in rows)
    assert secret_scan.scan(frame.limit(0)).count() == 0
    only_full = (secret_scan.BASE[2],)
    assert [len(r.spans) for r in secret_scan.scan(documents([(1, "0" * 24), (2, "f" * 23)]), only_full).orderBy("doc_id").collect()] == [1, 0]


def test_matches_hold_the_trigrams_of_a_query():
    """Every match of a random pattern holds all trigrams of some alternative of its query."""
    rng = random.Random(2)

    def pattern(depth=0):
        kind = rng.randrange(7)
        if depth > 3 or kind < 3:
            return "".join(rng.choice("abcAB") for _ in range(rng.randint(1, 4)))
        if kind == 3:
            return f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})"
        if kind == 4:
            return f"(?:{pattern(depth + 1)})" + rng.choice(["?", "*", "+", "{2}", "{1,3}"])
        if kind == 5:
            return rng.choice(["[ab]", "[a-z]", "[^x]", ".", "[A-C]"])
        return pattern(depth + 1) + pattern(depth + 1)

    mandatory = 0
    for _ in range(400):
        p = pattern() + pattern()
        query = secret_scan.trigram_query(p)
        mandatory += frozenset() not in query
        for _ in range(40):
            m = re.search(p, "".join(rng.choice("abcAB") for _ in range(30)))
            assert not m or any(all(g in m.group().lower() for g in grams) for grams in query), (p, m, query)
    assert mandatory > 100
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})} and secret_scan.trigram_query("[0-9a-f]{24,}") == {frozenset()}


def test_the_index_lists_what_holds_a_trigram(spark, documents):
    rows = [(i, t) for i, t in enumerate(["abcd", "xabc", "ABCx", "ab c", None, "bcd", "abcd"])]
    blocks = 3
    number = {t: n for t, n in documents(rows).select(F.coalesce("text", F.lit("")), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(blocks * secret_scan.BLOCK))).collect()}
    got = {(r.gram, r.block * secret_scan.BLOCK + m) for r in secret_scan.index(documents(rows), ["abc", "bcd", "zzz"], blocks).collect() for m in r.members}
    assert got == {(g, number[t or ""]) for _, t in rows for g in ("abc", "bcd", "zzz") if g in (t or "").lower()}


def plain_runs(words, least=12):
    n, found, seen = len(words), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    letters, n, kind = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 120), rng.random()
    if kind < 0.4:
        return [str(rng.randrange(letters)) for _ in range(n)]
    if kind < 0.55:
        words = ["a", "b"]
        while len(words[-1]) < n:
            words.append(words[-1] + words[-2])
        return list(words[-1])
    words = []
    while len(words) < n:
        unit = [str(rng.randrange(letters)) for _ in range(rng.randint(1, 20))]
        words += (unit * rng.randint(1, 6))[:rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("least", [12, 2, 7])
def test_runs_are_brute_force(least):
    rng = random.Random(least)
    total = 0
    for _ in range(200):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        for words, (n, found, rest) in zip(texts, runs._searched([" ".join(w).encode() for w in texts], least)):
            want = plain_runs(words, least)
            gone = {k for s, length, q in want for k in range(s + q, s + length)}
            assert n == len(words) and found == want and rest.decode() == " ".join(w for k, w in enumerate(words) if k not in gone)
            total += len(want)
    assert total > 1000


def test_range_successors():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        tree = runs.Wavelet(values)
        low, least = rng.integers(0, n, 300), rng.integers(0, 2 * n + 2, 300)
        high = rng.integers(low, n + 1)
        want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least)]
        assert tree.successor(low, high, least).tolist() == want


def test_runs_of_long_and_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 300_000), (5, "a b " * 6), (5, "a b " * 6), (None, "é  é " * 12), (6, "a " * 11)]
    frame = documents(rows).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")).repartition(2)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(frame).collect())
    assert got == sorted([("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 300_000, [(0, 300_000, 1)], "x"), ("5", 12, [(0, 12, 2)], "a b"), ("5", 12, [(0, 12, 2)], "a b"),
                          ("None", 12, [(0, 12, 1)], "é  é"), ("6", 11, [], " ".join("a" * 11))])
    assert runs.periodic_runs(frame.limit(0)).count() == 0


def test_runs_query_is_brute_force(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        words = re.findall(SPACE, r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want[r.doc_id] = (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % x for x in found)),
                          sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    got = {r.doc_id: tuple(r)[1:] for r in registered.op12_runs(spark, SMALL).collect()}
    assert {i: got[i] for i in want} == want and sum(w[0] for w in want.values()) > 20


def plain_audit(rows, least, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    docs = [(lang or "", source or "", term(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for d in own for t in d[2] if sum(t in e[2] for e in own) >= least}
        sources = sorted({d[1] for d in own})
        count = {g: {t: sum(d[2].count(t) for d in own if g in (None, d[1])) for t in kept} for g in [None, *sources]}
        share = {g: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for g, c in count.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for g in sources:
            pairs = [(s, sum(f(share[g][t], share[s][t]) for t in kept)) for s in sources if s != g]
            lead = [(t, f(share[g][t], share[None][t])) for t in kept if count[g][t] and share[g][t] > share[None][t]]
            for part, items, limit in (("pair", pairs, None), ("term", lead, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, g, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(10, 10), (2, 4), (1, 1)])
def test_audit_is_brute_force(spark, least, top):
    rng = random.Random(top)
    words = ["Ant", "ant", "bee", "été", "Été", "日本", "😀x", "a1b", "it's", "cat"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words[k % 7:]) for _ in range(rng.randint(0, 15))), rng.choice(["en", "de", None, "few"]) if k % 9 else "fr", rng.choice(["s0", "s1", "s1", "s2", None]))
            for k in range(150)]
    rows += [(None, "en", "bare"), ("", "empty", "s0"), ("12 34", "empty", "s1"), ("alone alone", "one", "s0")] + [rows[5]] * 12
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    assert sorted(map(tuple, divergence.audit(frame, least=least, top=top).collect())) == plain_audit(rows, least, top)


def test_audit_sends_full_tables_on(spark, monkeypatch):
    rows = [(f"{chr(97 + i % 26)}x {chr(97 + i % 7)}y", "en", f"s{i % 3}") for i in range(120)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "_HELD", 0)
    table = __import__("pyarrow").Table.from_pylist([dict(zip(("lang", "source", "text"), (r[1], r[2], r[0]))) for r in rows])
    parts = [b.to_pylist() for b in divergence._partial(table.to_batches(max_chunksize=7))]
    assert len(parts) > 10 and sum(r["n"] for p in parts for r in p) == 240
    assert divergence.audit(frame.limit(0)).count() == 0
