"""Toxicity, HTML, quality and token counts."""

import html
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from text_helpers import documents, package  # noqa: F401
from tradeledger.llm import html_text, quality, registered, rollups, toxicity

SF = SMALL.replace("0.001", "0.01")


def test_folding_undoes_disguises():
    folded, words = toxicity.fold(["Hello 1d10t w0rld!", "ｍоron cl​own a$s 1990", "", None, "É́x"])
    assert folded.split("\n")[:4] == [" heiio idiot worid ", " moron ciown ass ", " ", " "]
    assert words.tolist()[:4] == [3, 3, 0, 0]


def test_exceptions_cancel_matches_inside_them():
    weights = {" trash ": 5.0, " idio": 3.0}
    x = toxicity.figures(["trash day", "the trash day", "TR4SH idiots", "nothing"], weights, (" trash day ",))
    assert x[0].tolist() == x[1].tolist() == x[3].tolist() == [0, 0, 0]
    assert x[2].tolist() == [8.0, 40.0, 5.0]


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9 and hit / sum(r.predicted for r in rows) > 0.9


def test_toxicity_of_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (2, "trash"), (None, "trash"), (3, "word " * 50_000)]).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, None), (2, 1, 1), (None, 1, 1), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.toxicity(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.toxicity(docs.limit(0), some).count() == 0


def marked_article(page):
    """What the test pages call their article, cut out by its marks."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|li|ul)\b[^>]*>", re.sub("<br>", " ", inside))
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
    return "\n\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: marked_article(r.html) for r in pages.collect()}
    rows = registered.op6_html(spark, SF).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_boilerplate_without_marks(spark):
    weights = html_text.Weights({})
    long = " ".join(f"word{i}" for i in range(60))
    page = (f"<html><head><title>T</title><script>var a='<p>';</script></head><body><div id=cookie-notice><p>We use cookies on this site.</p></div>"
            f"<header><a href=/>Home</a> <a href=/b>More</a></header><div class='post'><h2>Head&nbsp;line</h2><p>{long}\n  &lt;end&gt;<br>x</p>"
            f"<form><input>Name <select><option>One</select></form><div class='ad'>Buy this thing now</div><p>{long} <b>bo</b>ld</p></div>"
            f"<section class='comments'><p>first!</p><p>second reader</p></section><aside><ul><li><a>Link</a></li></ul></aside><!-- <p>no</p> --><footer>(c) us</footer>")
    assert html_text.extract(page, weights) == f"Head line\n\n{long} <end> x\n\n{long} bold"
    assert [html_text.extract(p, weights) for p in (None, "", "<p></p>", "<script>x", "plain  text")] == ["", "", "", "", "plain text"]
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", "<p>a", 2), (None, None, "<!-- ", 3)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_text.main_text(odd).collect()) == ["", "", "a"]
    assert html_text.main_text(odd.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<p>one <svg-icon name=x></svg-icon> two</p><p>three</p>", "one two three"),
    ("<p>one</p><svg class=i/><p>two</p>", "one two"),
    ("<p>one</p><svg class='i' /><p>two</p><svg><text>no</text></svg><p>three</p>", "one two three"),
    ("<p>one</p><svg><path d='x'><p>two</p><svg><svg>no</svg>no</svg> three", "one two three"),
    ("<p>one <svg><title>no</title><foreignObject><p>no</p></foreignObject></svg> two</p>", "one two"),
    ("<p>one</p><svg><path/> two", "one two"),
    ("<p>one <title-bar>two </title-bar><object-view>three </object-view><style-x>four</style-x></p>", "one two three four"),
    ("<p>one <math><mi>x</mi><mo>=</mo></math> two <object data=a>three </object><math/>four <object/>five</p>", "one x= two three four five"),
    ("<p>one</p><template><p>no</p></template><p>two</p><template><p>three</p>", "one two three"),
    ("<p>one</p><script>no</script><style>no</style ><p>two</p><script>no <p>no</p>", "one two"),
])
def test_text_after_raw_elements_stays(page, want):
    weights = html_text.Weights({})
    long = " ".join(f"word{i}" for i in range(60))
    assert html_text.extract(f"<p>{long}</p>{page}", weights).split()[60:] == want.split()


def test_unclosed_drawings_take_linear_time():
    page = "word " * 60 + "<svg>" * 20_000 + "end"
    assert sum(len(t.split()) for t, *_ in html_text.tokens(page)) == 61


def test_boilerplate_is_told_from_all_words():
    weights = html_text.Weights({})
    long = " ".join(f"word{i}" for i in range(60))
    utility = "bg-white border border-gray-200 flex flex-col gap-4 items-center justify-between"
    for last in ("newsletter", "sidebar", "subscribe", "x-widget"):
        page = f"<p>{long}</p><div class='{utility} space-y-2 {last}'><p>Sign up now</p></div><p>{long}</p>"
        assert html_text.extract(page, weights) == f"{long}\n\n{long}"
    assert html_text.extract(f"<div class='{utility} space-y-2 text-adjust{'x' * 80}'><p>{long}</p></div>", weights) == long
    keys = {key for n in range(50) for _, _, key, _ in html_text.tokens(f"<div class='{'w' * 5000} {utility} c{n}'>") if key}
    assert len(keys) == 50 and max(map(len, keys)) < 100


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def plain_score(text, model):
    mask = (1 << model.bits) - 1
    words = [xxhash.xxh64_intdigest(w, 42) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(words, words[1:])]
    found = [model.ratios[w & mask] for w in words] + [model.ratios[(p & mask) + mask + 1] for p in pairs]
    return sum(found) / max(1, len(found))


def test_quality_is_brute_force(spark, documents):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rng = random.Random(8)
    odd = [(-1 - i, "".join(rng.choice(["x", "0B", "é", "a b", " ", "\n", "\t", "\x0b", "\x0c", "\r", "#", "|", " ", "😀"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    odd += [(None, None), (5, ""), (6, "a " * 30), (7, " ".join(str(i % 16) for i in range(40))), (7, "w " * 60_000)]
    model = quality.fit(docs, labels)
    both = docs.unionByName(documents(odd)).withColumn("n_words", F.lit("x"))
    rows = quality.judged(both, model).collect()
    assert len(rows) == docs.count() + len(odd)
    for r in rows:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == plain_counts(r.text)
        assert r.score == pytest.approx(plain_score(r.text, model), abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= model.threshold)


def test_quality_keeps_the_good_and_works_without_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.judged(docs, quality.fit(docs, labels)).where("NOT base_failed").join(labels, "doc_id").collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.98 * len(kept[1]) and sum(kept[0]) <= 0.2 * len(kept[0])
    model = quality.fit(docs, labels.limit(0))
    assert quality.judged(docs, model).where("kept = base_failed").count() == 0
    assert quality.judged(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_quality_counts_every_trusted_text(spark):
    n = 22_000
    docs = spark.range(-n, n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 20), i -> concat('w', pmod(xxhash64(id, i), 900)))) AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 2 = 0, 1, 0) AS quality").union(spark.sql("SELECT 1L, 0")).union(spark.sql("SELECT 2L, 1"))
    model = quality.fit(docs, labels)
    counted = lambda rows: quality._counted(quality.with_words(rows.select("text")), model.bits)
    trusted = docs.where("doc_id % 2 = 0")
    assert model.ratios == quality._ratios(counted(trusted), counted(docs), model.bits)
    scores = sorted(r.score for r in trusted.select("text").transform(quality.with_words).select(quality.score(model).alias("score")).collect())
    low = model.threshold + quality.SLACK
    assert 0.0045 <= sum(s < low for s in scores) / len(scores) <= 0.0055


def test_rollups_are_recounts(spark, tmp_path):
    rng, base, held = random.Random(6), str(tmp_path), {}

    def totals():
        return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollups.totals(spark, base).collect()}

    for batch in range(1, 7):
        rows = [(rng.choice([*range(30), None]), rng.randrange(4), rng.choice(["insert", "revise", "delete", "Insert", "other"]), rng.choice(["s", None]),
                 rng.choice(["en", "de"]), rng.choice(["v1", "v2"]), rng.choice([1, 5, 100, None])) for _ in range(40)]
        rows += rows[:3]
        changes = spark.createDataFrame(rows, rollups.CHANGES)
        last = {}
        for d, seq, op, s, lang, v, n in rows:
            if d is not None and op.lower() != "other":
                key = (seq, op.lower(), (s is not None, s or ""), lang, n or 0)
                last[d, v] = max(last.get((d, v), key), key)
        for where, (_, op, (_, s), lang, n) in last.items():
            held.pop(where, None)
            if op != "delete":
                held[where] = (s or None, lang, n)
        assert rollups.apply_batch(base, batch, changes)
        want = {}
        for (d, v), (s, lang, n) in held.items():
            a, b = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (a + 1, b + n)
        assert totals() == want
        assert not rollups.apply_batch(base, batch, changes) and totals() == want
        if batch == 3:
            assert rollups.fold(spark, base) == 3 and totals() == want
            assert not rollups.apply_batch(base, 2, changes)
        if batch == 4:      # a batch that stopped before its commit counts nothing
            rollups.signed(changes, rollups.current(spark, base)).write.parquet(f"{base}/changes/batch=5")
            assert totals() == want
    assert rollups.apply_batch(base, 7, changes.limit(0)) and totals() == want


def test_token_count_query(spark):
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in registered.op10_token_counts(spark, SMALL).collect()}
    encode, want = registered.packing._encoding("byte_bpe_50k.tiktoken").encode_ordinary, {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        if len(r.text.split()) >= 20:
            a, b = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (a + 1, b + len(encode("\n".join(dict.fromkeys(r.text.split("\n"))))))
    assert got == want


ARTICLE = "<p>" + "One two three four five six seven eight nine ten. " * 6 + "</p><p>" + "Alpha beta gamma delta epsilon zeta eta theta. " * 5 + "</p>"
ARTICLE_TEXT = "\n\n".join(" ".join(part.split()) for part in ("One two three four five six seven eight nine ten. " * 6, "Alpha beta gamma delta epsilon zeta eta theta. " * 5))


@pytest.fixture(scope="module")
def page_weights(spark):
    return html_text.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


@pytest.mark.parametrize("names", ["class='content no-sidebar'", "id=page class='has-cookie-banner'", "class=with-footer", "class='comments-enabled'", "class=share-buttons-on",
                                   "class=sidebar-layout", "id=widget-page"])
def test_wrappers_named_after_boilerplate_keep_their_article(page_weights, names):
    page = f"<body><nav><a href=/>Home</a> <a>News</a></nav><div {names}>{ARTICLE}</div><div class=comments><p>I like it very much</p></div></body>"
    assert html_text.extract(page, page_weights) == ARTICLE_TEXT


def test_headlines_in_the_articles_own_head(page_weights):
    menu = "<header><a>Site</a></header><nav><a>Home</a></nav>"
    for head in ("<header><h1>The headline here</h1></header>", "<div class=entry-header><h1>The headline here</h1></div>"):
        assert html_text.extract(f"{menu}<article>{head}{ARTICLE}</article>", page_weights) == f"The headline here\n\n{ARTICLE_TEXT}"


def test_quoted_values_of_any_length(page_weights):
    assert html_text.extract(f"<body><div data-x=\"{'a>b ' * 5000}\" title='{'c>' * 9000}'>{ARTICLE}</div></body>", page_weights) == ARTICLE_TEXT


@pytest.mark.parametrize("unit", ["<b>x ", "<a ", "<b>x</i> ", '<a "x ', "<p>x<div>", "<svg>", "<!-- ", "<title>", "</b"])
def test_broken_markup_takes_linear_time(page_weights, unit):
    import time

    took = []
    for n in (4_000, 32_000):
        started = time.process_time()
        html_text.extract(unit * n, page_weights)
        took.append(time.process_time() - started)
    assert took[1] < 30 * took[0] + 0.5


def test_the_scan_finds_the_best_of_all_stretches(page_weights):
    rng = random.Random(8)
    for _ in range(60):
        parts = [rng.choice(["<p>", "</p>", "<div class=menu>", "</div>", "<li>", "a few words here ", "x ", "<b>", "</b>", "<footer>", "</footer>", "long text of many words in a row "]) for _ in range(40)]
        page, made = "".join(parts), []
        events = list(html_text._walk(page, made))
        html_text._rated(made, sum(e[1] for e in events), page_weights)
        scores = []
        for _, words, element, key, _ in events:
            if words:
                scores.append(words * (1.0 if element is None else element.head if element.heading else element.score))
            if key:
                scores.append(page_weights.tag(key))
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert abs(html_text.best_stretch(scores)[2] - best) < 1e-9


def test_marks_taken_out_change_no_text(spark, page_weights):

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        assert html_text.extract(r.html, page_weights) == html_text.extract(re.sub(r"(?i)</?(article|main)\b[^>]*>", "", r.html or ""), page_weights)
