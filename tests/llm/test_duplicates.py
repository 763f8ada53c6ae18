"""SimHash, embeddings and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from conftest import SMALL
from text_helpers import documents, package  # noqa: F401
from tradeledger.llm import embeddings, simhash
from tradeledger.llm.components import components


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame([*links, (None, 1), (2, None), (7, 7)], "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in classes(linked, links).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_planes_find_what_counting_finds(radius):
    rng = np.random.default_rng(radius)
    for _ in range(15):
        n = int(rng.integers(0, 300))
        fp = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
        for _ in range(3):
            fp = fp ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        group = np.sort(rng.integers(0, 4, n))
        i, j = simhash.close_pairs(fp, group, radius)
        got = list(zip(i.tolist(), j.tolist()))
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want
        assert simhash.stars(n, i, j).tolist() == [classes(range(n), want)[k] for k in range(n)]


def some_texts():
    rng = random.Random(11)
    words = ["Ant", "bee", "CAT", "dog", "é", "eel", "fox", "gnu", "hen"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = [(i, " ".join(rng.choice(base))) for i in range(60)]
    for i in range(60, 160):            # near copies
        text = list(rng.choice(base)) * 6
        text[rng.randrange(len(text))] = "zebu"
        rows.append((i, "\t".join(text)))
    return [*rows, (200, None), (201, ""), (202, " \n"), (203, "one"), (3, rows[3][1]), (None, rows[5][1]), (204, "ÀB c d")]


@pytest.mark.parametrize("crowd", [512, 2])
def test_simhash_is_brute_force(spark, crowd):
    rows = some_texts()
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string"), crowd=crowd)
    prints = {t: plain_fingerprint(t) for _, t in rows}
    nodes = sorted(set(prints.values()))
    found = classes(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            least[found[prints[t]]] = min(i, least.get(found[prints[t]], i))
    want = sorted((str(i), f"{prints[t]:016x}", least[found[prints[t]]]) for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_class_stays(spark):
    rows = some_texts() + [(None, None), (None, "an own class " * 5), (None, "an own class " * 5)]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, fp int, component_id string, `class` double").repartition(3)
    got = simhash.representatives(frame)
    assert got.columns == frame.columns
    prints = {t: plain_fingerprint(t) for _, t in rows}
    nodes = sorted(set(prints.values()))
    found = classes(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in rows:
        least[found[prints[t]]] = min(9e9 if i is None else i, least.get(found[prints[t]], 9e9))
    kept = got.collect()
    assert sorted((found[prints[r.text]], 9e9 if r.doc_id is None else r.doc_id) for r in kept) == sorted(least.items())
    assert {(r.fp, r.component_id, r["class"]) for r in kept} == {(1, "x", 2.0)}
    assert simhash.representatives(frame.limit(0)).count() == 0


def test_close_fingerprints_survive_refining(spark):
    """Thousands of values that share 32 bits, far more than a crowd."""
    rng = np.random.default_rng(1)
    values = {int(v) for v in (rng.integers(0, 1 << 32, 3000, dtype=np.uint64) & np.uint64(0xF0F0F00F)) | np.uint64(0xABCD1234 << 32)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.link_prints(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd=16)
    got = {r[0]: r[1] for r in components(links).collect()}
    array = np.array(signed, np.int64)
    i, j = simhash.close_pairs(array.view(np.uint64), np.zeros(len(array)))
    want = classes(signed, [(signed[a], signed[b]) for a, b in zip(i, j)])
    assert {v: got.get(v, v) for v in signed} == want


@pytest.mark.parametrize("block", [2048, 20])
def test_embeddings_are_brute_force(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in (base[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.4)).astype(np.float32)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(70)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, None] * 8), (504, []),
                                                          (505, [1.0, 2.0]), (506, [1.0, 2.0]), (7, rows[7][1]), (507, [float("inf")] + [0.0] * 15)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, node int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame, block=block, recall=0.9999).collect())
    sound = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, v in sound for b, w in sound if a < b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9]
    found = classes(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[found[k]] = min(i, least.get(found[k], i))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert got == sorted((i, int(n[k]), least[found[k]], i == least[found[k]]) for k, (i, _) in enumerate(rows))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    links = int((v @ v.T >= 0.9).sum()) - len(v)
    assert sum(r.n_links for r in embeddings.near_duplicates(table).collect()) >= 0.9 * links


def test_classes_that_share_an_id_all_stay(spark, documents):
    rows = [(7, "one text of this id " * 6), (7, "quite another one with the same " * 6), (7, "one text of this id " * 6), (9, "Quite another one with the same " * 6)]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, documents(rows), SMALL).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in got) == sorted({r for r in rows[:3]})
