"""Cross-parsing against a plain greedy parse, and held-out accuracy."""

import random

import pytest

from conftest import SMALL
from text_helpers import documents, package  # noqa: F401
from tradeledger.llm import language


def folded(text, letters):
    out = ""
    for c in text:
        c = (c.lower()[:1] if c.lower()[:1] in letters else "\0") if c.isalpha() else " "
        if c != " " or out[-1:] not in ("", " "):
            out += c
    return out


def plain_phrases(text, samples, letters):
    """Longest matches in any of the samples, block by block."""
    text, n = folded(text, letters), 0
    samples = [folded(s, letters) for s in samples]
    for start in range(0, len(text), language.BLOCK):
        block = text[start:start + language.BLOCK]
        at = 0
        while at < len(block):
            size = 1
            while at + size < len(block) and any(block[at:at + size + 1] in s for s in samples):
                size += 1
            at += size
            n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": [make("abcde ", 200), make("abc", 40)], "b": [make("cdefg ", 240)]}
    model = language.build(samples)
    texts = [make("abcdefgxyz .1", rng.randint(1, 700)) for _ in range(25)] + ["x", "a", "É漢 a"]
    counts, _ = language.phrases(model, texts)
    for text, row in zip(texts, counts):
        if any(c.isalpha() for c in text):
            assert row.tolist() == [plain_phrases(text, samples[name], model.letters) for name in model.languages], text


def test_texts_without_letters_and_without_training(spark, documents):
    rows = [(i, "the cat sat on the mat and the hat", "en") for i in range(0, 40)] + [(i, "der hund und die katze auf dem dach", "de") for i in range(40, 70)]
    docs = documents([*rows, (90, None, "en"), (91, "", "de"), (92, "12 34 !", None), (93, "the mat", None), (None, "die katze", None)])
    docs = docs.selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS held_out")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0)
    assert got[93][0] == "en" and got[None][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("folder", [SMALL.replace("0.001", "0.01")])
def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.identify(docs).where("held_out").join(docs.where("n_chars > 100"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
