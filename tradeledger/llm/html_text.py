"""Main text of web pages as the best-scoring stretch of words and tags.

A page is a sequence of words and tags.  Words score by the element around
them, plus one in running text; tags score below zero.  One linear scan finds
the contiguous stretch with the greatest sum: the article, since menus, notices
and footers are dense in tags that the weights call costly.

Weights come from labelled pages, those that mark their article themselves
(``article`` or ``main``): how often a tag, or a word below it, is inside the
mark and how often outside.  Names that mean boilerplate on any page start out
with counts outside.  Up to ``SAMPLE`` pages are learned from.

Inside the stretch, words of boilerplate elements (a notice in the middle of
the article) are left out.  Null or empty html, and pages without words, give
an empty text.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeledger.llm.common import bounded_rows, in_slices

SAMPLE = 512
KEYS = 5000             # different tags whose counts are kept, the most frequent first
_SLICE = 2_000_000

# HTML elements that begin a new block of text.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements, and words in class, id or role, that mean boilerplate.
_BOILER = frozenset("nav header footer aside form button select menu dialog label fieldset".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related "
    "reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
_MARKS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are boilerplate however much of a page they hold.
_NEVER_ALL = frozenset("nav menu select button footer".split())

# Elements whose '/>' closes them, and HTML inside of ``svg``.
_CLOSABLE = frozenset(("math", "object"))
_FOREIGN = frozenset(("foreignobject", "desc", "title"))

# What a tag may hold: quoted values of any length, in which '>' does not end it.
_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAG = re.compile(rf"<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>{_REST})>", re.I)
# The same where quotes do not pair up.
_PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>[^>]*+)>", re.I)
_START = re.compile(r"<(?:!--|[!?]|/?[a-z])", re.I)
# Only what browsers take as raw text runs to the end of a page that lacks its end tag.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "noscript", "textarea", "iframe", "title")}
_BROKEN = 16            # tags of a page whose quotes never end, after which quotes are not looked at
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Words that turn a name of boilerplate into a setting of the page, and what an article's own head is called.
_SETTING = frozenset("no not without with has have is hide hidden show enabled disabled on off open closed".split())
_OWN_HEAD = frozenset("entry post article story page".split())
# Boilerplate that may hold most words of a page; other names that do are those of a wrapper.
_MANY_WORDS = frozenset("comment comments commentlist disqus reply replies related".split())
_MOST = 0.8             # share of a page's words that makes an element a wrapper
_HEADLINE = 8           # what a heading in a marked article scores besides its words


def _boiler_words(names: str) -> set[str]:
    """Words of class, id and role names that mean boilerplate."""
    found: set[str] = set()
    for name in names.split("."):
        words = set(re.split(r"[^a-z]+", name))
        meant = words & _BOILER_WORDS
        if not (words & _SETTING or meant == {"header"} and words & _OWN_HEAD):
            found |= meant
    return found


def _bounded(words: list[str]) -> str:
    """The words joined; of a long list those that mean boilerplate and a number that tells it from others."""
    joined = ".".join(words)
    if len(joined) <= 80:
        return joined
    return ".".join([*sorted(_boiler_words(joined)), str(zlib.crc32(joined.encode("utf-8", "surrogatepass")))])


def _after(page: str, name: str, at: int) -> int | None:
    """Where a ``template`` or ``svg`` whose start tag ends at ``at`` is over, None if it is not.

    A block that does not belong to the drawing ends ``svg``, as in browsers.
    """
    depth, inner = 1, 0
    for m in _TAG.finditer(page, at):
        found, end = m["name"].lower(), bool(m["end"])
        if found == name:
            depth += -1 if end else not (name == "svg" and m["rest"].endswith("/"))
            if not depth:
                return m.end()
        elif name == "svg" and found in _FOREIGN:
            inner = max(0, inner - 1) if end else inner + (not m["rest"].endswith("/"))
        elif name == "svg" and found in _BLOCKS and not end and not inner:
            return m.start()
    return None


def tokens(page: str):
    """``(text before, name, key, is end)`` for each tag in page order; name None for what is no tag, and at the end."""
    text_at = at = broken = 0
    endless = set()
    while m := _START.search(page, at):
        start, lead = m.start(), m.group()
        if lead == "<!--":
            end = page.find("-->", m.end())
            end, m = (end + 3 if end >= 0 else len(page)), None
        elif lead in ("<!", "<?"):
            end = page.find(">", m.end()) + 1
            m = None
        else:
            m = (_TAG.match(page, start) if broken < _BROKEN else None) or _PLAIN_TAG.match(page, start)
            if m and m.re is _PLAIN_TAG:
                broken += 1
            end = m.end() if m else 0
        if not end:                                 # no '>' any more: no tag either
            break
        text, at = page[text_at:start], end
        name = m["name"].lower() if m else None
        if name in _RAW and not m["end"]:           # left out with all it holds
            over = _RAW[name].search(page, at)
            at, name = (over.end() if over else len(page)), None
        elif name in ("svg", "template"):           # left out; without an end only the tag is
            if not m["end"] and name not in endless and not (name == "svg" and m["rest"].endswith("/")):
                after = _after(page, name, at)
                if after is None:
                    endless.add(name)
                else:
                    at = after
            name = None
        text_at = at
        if not name:
            yield text, None, None, False
            continue
        rest = m["rest"]
        if rest and not m["end"] and "=" in rest:
            words = sorted({w for found in _NAMED.findall(rest) for w in "".join(found).lower().split()})
            key = f"{name}.{_bounded(words)}" if words else name
        else:
            key = name
        yield text, name, key, bool(m["end"])
        if name in _CLOSABLE and not m["end"] and rest.endswith("/"):
            yield "", name, key, True
    yield page[text_at:], None, None, False


def _boiler(key: str) -> bool:
    name, _, words = key.partition(".")
    return name in _BOILER or bool(_boiler_words(words))


class Element:
    """An element of a page: what it is, the one around it, and the words that it holds inside and outside of a marked article."""

    __slots__ = ("name", "key", "around", "inside", "outside", "marked", "heading", "covered", "score", "head")

    def __init__(self, name: str, key: str, around: "Element | None", covered: bool):
        self.name, self.key, self.around, self.covered = name, key, around, covered
        self.inside = self.outside = 0
        self.marked = name in _MARKS or around is not None and around.marked
        self.heading = name in _HEADINGS or around is not None and around.heading
        self.score = self.head = 1.0


def _walk(page: str, made: list[Element]):
    """``(text, words, element, tag key, tag name)``: each stretch of text with the innermost element around it, then the tag that follows.

    An end tag closes the nearest element of its name and all inside it; one without such an element closes nothing.
    ``made`` gets all elements, outer ones first; their words are known once the walk is over.
    """
    path: list[Element] = []
    places: dict[str, list[int]] = {}       # where in the path the elements of a name are
    keys: Counter = Counter()               # keys in the path
    blocks: list[int] = []                  # where the blocks are

    def close(at: int) -> None:
        while len(path) > at:
            element = path.pop()
            places[element.name].pop()
            keys[element.key] -= 1
            if path:
                path[-1].inside += element.inside
                path[-1].outside += element.outside
        while blocks and blocks[-1] >= at:
            blocks.pop()

    for text, name, key, end in tokens(page):
        inner, words = path[-1] if path else None, len(text.split())
        if inner is not None and words:
            if inner.marked:
                inner.inside += words
            else:
                inner.outside += words
        if name and end:
            at = places[name][-1] if places.get(name) else None
            key = path[at].key if at is not None else key
            yield text, words, inner, f"/{key}", name
            if at is not None:
                close(at)
            continue
        yield text, words, inner, key, name
        if name and name not in _VOID:
            if name in _BLOCKS:          # a new block ends an open paragraph and what is open inside it
                at = places["p"][-1] if places.get("p") else None
                if at is not None and blocks[-1] == at:
                    close(at)
                blocks.append(len(path))
            places.setdefault(name, []).append(len(path))
            path.append(Element(name, key, path[-1] if path else None, keys[key] > 0))
            keys[key] += 1
            made.append(path[-1])
    close(0)


def _says(element: Element) -> bool:
    """Does the element say what its words are?"""
    return element.name not in _MARKS and element.name not in ("html", "body")


def count(page: str) -> tuple[Counter, Counter]:
    """Tags, and words by element around them (``w:`` keys), inside and outside of a page's marked article."""
    inside, outside, made = Counter(), Counter(), []
    for _, _, element, key, name in _walk(page, made):
        if key:
            own = inside if element is not None and element.marked and not (name in _MARKS and key.startswith("/")) else outside
            own[key] += 1
    for element in made:
        if _says(element) and not element.covered:          # words count once for each key around them
            for by, words in ((inside, element.inside), (outside, element.outside)):
                if words:
                    by[f"w:{element.key}"] += words
    return inside, outside


class Weights:
    """Scores of tags and of words, from counts ``key -> (inside, outside)``."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self._tag: dict[str, float] = {}
        self._word: dict[str, float] = {}

    def _odds(self, key: str, boiler: bool) -> float:
        found = self.counts.get(key) or (0, 0)
        return math.log((found[0] + (0 if boiler else 1) + 0.5) / (found[1] + (3 if boiler else 0) + 0.5))

    def tag(self, key: str) -> float:
        if key not in self._tag:
            name = key.lstrip("/")
            cost = 1 - self._odds(key, _boiler(name) or name in _MARKS)
            self._tag[key] = -min(12.0, max(0.3, cost))
        return self._tag[key]

    def word(self, key: str, wrapper: bool = False) -> float:
        """What an element says of its words; ``wrapper``: it holds most of the page, so its name does not mean boilerplate."""
        named = f"{key} " if wrapper else key
        if named not in self._word:
            self._word[named] = max(-1.0, min(1.0, self._odds(f"w:{key}", _boiler(key) and not wrapper)))
        return self._word[named]


def _rated(made: list[Element], total: int, weights: Weights) -> None:
    """Each element's score, the lowest of its own and those around it.

    ``head`` is that of headings: a header inside the article does not count against them.
    """
    for element in made:
        around = element.around
        score, head = (around.score, around.head) if around is not None else (1.0, 1.0)
        if _says(element):
            names = _boiler_words(element.key.partition(".")[2])
            wrapper = element.inside + element.outside > _MOST * total and element.name not in _NEVER_ALL and not names & _MANY_WORDS
            own = weights.word(element.key, wrapper)
            of_article = element.marked and (element.name == "header" or names == {"header"}) and not names - {"header"}
            score, head = min(score, own), head if of_article else min(head, own)
        element.score, element.head = score, head


def best_stretch(scores: list[float]) -> tuple[int, int, float]:
    """``(first, end, sum)`` of the contiguous stretch with the greatest sum, in one pass; the earliest of equals, none below zero."""
    best, total, start, first, last = 0.0, 0.0, 0, 0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    return first, last, best


def extract(page: str | None, weights: Weights) -> str:
    """The blocks of the best stretch, two line ends between them."""
    made: list[Element] = []
    events = list(_walk(page or "", made))
    _rated(made, sum(words for _, words, *_ in events), weights)
    steps = []                                  # (score, text, word score, begins a block; None: a line break)
    for text, words, element, key, name in events:
        if words:
            each = 1.0 if element is None else element.head if element.heading else element.score
            headline = element is not None and element.marked and element.heading and each > 0
            steps.append((words * each + _HEADLINE * headline, text, each, False))
        if key:
            own_head = name == "header" and element is not None and element.marked
            cost = weights.tag("/div" if key[0] == "/" else "div") if own_head else weights.tag(key)
            steps.append((cost, None, 0.0, None if name == "br" else name in _BLOCKS))
    first, last, _ = best_stretch([score for score, *_ in steps])
    blocks, current = [], []
    for _, text, each, begins in steps[first:last]:
        if text is not None:
            if each > 0:
                current.append(entities.unescape(text))
        elif begins:
            blocks.append("".join(current))
            current = []
        elif begins is None:
            current.append(" ")
    blocks.append("".join(current))
    return "\n\n".join(b for b in (" ".join(block.split()) for block in blocks) if b)


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from up to ``sample`` different pages that mark their article."""
    marked = pages.select(F.col(html).alias("html")).where("html RLIKE '(?i)<(article|main)[ >]'")
    chosen = bounded_rows(marked, None, "html", sample)

    def apply(batches):
        for part in in_slices(batches, "html", _SLICE):
            inside, outside = Counter(), Counter()
            for page in part.column("html").to_pylist():
                i, o = count(page)
                inside.update(i)
                outside.update(o)
            keys = sorted({*inside, *outside})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()),
                                              pa.array([outside[k] for k in keys], pa.int64())], names=["key", "i", "o"])

    counts = chosen.mapInArrow(apply, "key string, i bigint, o bigint").groupBy("key").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return Weights({r["key"]: (r["i"], r["o"]) for r in counts.orderBy(F.expr("i + o").desc(), "key").limit(KEYS).collect()})


def main_text(pages: DataFrame, html: str = "html", weights: Weights | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of the html.

    Null html counts as empty.  Bytes that are no UTF-8 count as U+FFFD.  Repeated
    rows come back repeated; columns named ``text`` or ``n_chars`` are replaced.
    """
    counts = (weights or fit(pages, html)).counts
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def apply(batches):
        learned = Weights(counts)
        for part in in_slices(batches, html, _SLICE):
            texts = [extract(p, learned) for p in part.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*kept, "text", "n_chars"])

    return pages.select(*(pages[f"`{c}`"] for c in kept), F.make_valid_utf8(pages[f"`{html}`"]).alias(html)).mapInArrow(apply, schema)
