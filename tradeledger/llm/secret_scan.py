"""Secrets in texts, found through a trigram inverted index and verified by the rules' own patterns.

1. From each rule's pattern a Boolean trigram query is derived: alternatives, each
   a set of trigrams that every match of that alternative holds (ASCII letters
   folded).  A rule with an alternative that holds none is scanned fully.
2. The index has a posting list per trigram and block: the texts of the block that
   hold it.  Texts are numbered by a hash of their content, eight numbers to a
   text, so copies share a number and a task sends it once.  A number shared by
   different texts only adds a candidate.  Only trigrams that a query names are
   indexed (``index(docs, grams)`` takes any).
3. Posting lists of an alternative are intersected, those of a rule's alternatives
   united.
4. Each row is verified by the rules that it is a candidate of, and by those
   that scan fully.  Candidates are written to the shared folder first: few are
   broadcast by their measured size, many are joined by number, where adaptive
   execution splits numbers that many copies share.

Built-in functions only.  A match never depends on anything but its own text, so
repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tradeledger.sources.sinks import staging_path

BLOCK = 4096            # numbers of a block
ROOM = 8                # numbers for each text
ALTERNATIVES = 64       # of a query; what would make more counts as text that may be anything


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, from left to right, without overlap; those whose group ``part`` is shorter than ``least`` are dropped.

    Patterns mean the same to Java, RE2 and Python: no flags, no look-around, no back-references, only ASCII classes.
    """

    kind: str
    pattern: str
    least: int = 0
    part: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The formats of well-known secrets.
BASE = (
    Rule("assign", f"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})"
         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),      # runs are matched whole, so the length can stand in the pattern
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("login_url", r"://[^\x20\x09-\x0D/:@]{1,200}:[^\x20\x09-\x0D/@]{1,200}@"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives of trigrams that a match must hold, smallest sets only; one empty set: nothing is mandatory."""
    from re import _constants as op, _parser as parser

    def grams(run: str) -> frozenset[str]:
        return frozenset(run[i:i + 3] for i in range(len(run) - 2))

    def closed(states):
        return {(held | grams(run), "") for held, run in states}

    def letters(items) -> set[str] | None:
        out: set[str] = set()
        for kind, value in items:
            if kind is op.LITERAL:
                out.add(chr(value))
            elif kind is op.RANGE and value[1] - value[0] < 8:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return {c.lower() for c in out} if all(c < "\x80" for c in out) else None

    def follow(states, tree):
        for kind, value in tree:
            before = states
            if kind is op.LITERAL:
                states = {(held, run + chr(value).lower()) for held, run in states} if value < 128 else closed(states)
            elif kind is op.IN and (found := letters(value)):
                states = {(held, run + c) for held, run in states for c in found}
            elif kind is op.BRANCH:
                states = set().union(*(follow(states, b) for b in value[1]))
            elif kind is op.SUBPATTERN:
                states = follow(states, value[-1])
            elif kind is op.MAX_REPEAT and value[0] == 1 == value[1]:
                states = follow(states, value[2])
            elif kind is op.MAX_REPEAT and value[0] == 0 and value[1] == 1:
                states = states | follow(states, value[2])
            elif kind is op.MAX_REPEAT and value[0] > 0:
                states = closed(follow(closed(follow(states, value[2])), value[2]) if value[0] > 1 else follow(states, value[2]))
            else:
                states = closed(states)
            if len(states) > ALTERNATIVES:
                states = closed(before)
        return states

    found = {held for held, _ in closed(follow({(frozenset(), "")}, parser.parse(pattern)))}
    return frozenset(a for a in found if not any(b < a for b in found))


def _text(column: str) -> Column:
    return F.make_valid_utf8(F.coalesce(F.col(column), F.lit("")))


def _number(text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(blocks * BLOCK))


def index(docs: DataFrame, grams: Iterable[str], blocks: int, text: str = "text") -> DataFrame:
    """``gram, block, members``: for each of the ``grams`` (folded) the numbers of the block's texts that hold it, in order."""
    held = F.filter(F.array(*(F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in sorted(grams))), lambda g: g.isNotNull())
    # Folded once, in a step of its own.
    rows = docs.select(_text(text).alias("t")).select(_number(F.col("t"), blocks).alias("number"), F.lower("t").alias("folded")).select("number", held.alias("grams"))
    # An outer unpacking, as the plain one adds a filter on the list, which is pushed down to fold the text for every trigram.
    return (
        rows.select(F.explode_outer("grams").alias("gram"), F.expr(f"number div {BLOCK}").alias("block"), F.expr(f"CAST(number % {BLOCK} AS INT)").alias("member"))
        .where("gram IS NOT NULL").groupBy("gram", "block").agg(F.array_sort(F.collect_set("member")).alias("members"))
    )


def candidates(postings: DataFrame, queries: dict[int, frozenset[frozenset[str]]]) -> DataFrame:
    """``number, rules``: the numbers that satisfy the queries of the rules (by their place)."""
    clauses = [(rule, n, len(grams), gram) for rule, query in queries.items() for n, grams in enumerate(sorted(map(sorted, query))) for gram in grams]
    named = postings.sparkSession.createDataFrame(clauses, "rule int, clause int, size int, gram string")
    met = (
        postings.join(F.broadcast(named), "gram")           # as many rows as the rules' patterns name trigrams
        .groupBy("rule", "clause", "size", "block").agg(F.collect_list("members").alias("lists")).where("size(lists) = size")
        .select("rule", "block", F.explode(F.expr("aggregate(slice(lists, 2, size), lists[0], (a, x) -> array_intersect(a, x))")).alias("member"))
    )
    return met.groupBy((F.col("block") * BLOCK + F.col("member")).alias("number")).agg(F.collect_set("rule").alias("rules"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(place: int, rule: Rule, text: Column) -> Column:
    """Spans ``(start, place, end)`` of a rule in a text, in characters.

    Matches and what lies between them add up to positions.  Sums are taken in
    blocks of about the square root of the number of matches.
    """
    pattern = F.lit(rule.pattern)
    zero = F.lit(0)
    add = lambda a, x: a + x
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")

    def positions(hits: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.char_length(g) + F.char_length(h))
        return _let(steps, lambda e: _let(F.ceil(F.sqrt(F.size(e))).cast("int"), lambda b: _let(
            F.transform(F.sequence(zero, F.floor((F.size(e) - 1) / b).cast("int")), lambda j: F.aggregate(F.slice(e, j * b + 1, b), zero, add)),
            lambda sums: _let(
                F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, 1, j), zero, add)),
                lambda base: F.transform(e, lambda _, i: _let(
                    base[F.floor(i / b).cast("int")] + F.aggregate(F.slice(e, F.floor(i / b).cast("int") * b + 1, i % b + 1), zero, add),
                    lambda end: F.struct((end - F.char_length(hits[i])).alias("start"), F.lit(place).alias("place"), end.alias("end"))))))))

    def found(hits: Column) -> Column:
        spans = positions(hits)
        if rule.least:
            long = F.regexp_extract_all(text, pattern, F.lit(rule.part)) if rule.part else hits
            spans = _let(long, lambda parts: F.filter(spans, lambda _, i: F.char_length(parts[i]) >= rule.least))
        return F.when(F.size(hits) > 0, spans).otherwise(none)

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: [(kind, start, end)] by start, then rule, in characters, ends exclusive.

    A null text counts as empty and has none.  Bytes that are no UTF-8 count as
    U+FFFD.  A column named ``spans`` is replaced; others stay, whatever their
    names.  Rows stay as they are, repeated ones too.
    """
    spark = docs.sparkSession
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    asked = {n: q for n, q in queries.items() if frozenset() not in q}
    kept = [c for c in docs.columns if c != "spans"]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"), _text(text).alias("t"))
    if asked:
        blocks = -(-max(docs.count(), 1) * ROOM // BLOCK)
        grams = {g for q in asked.values() for clause in q for g in clause}
        path = staging_path(spark, "secret_candidates")
        candidates(index(docs.select(text), grams, blocks, text), asked).write.parquet(path)
        few = spark.read.schema("number bigint, rules array<int>").parquet(path)
        rows = rows.withColumn("number", _number(F.col("t"), blocks)).join(few, "number", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    t, none = F.col("t"), F.array().cast("array<struct<start:int,place:int,end:int>>")
    each = [
        F.when(F.array_contains("rules", n), _spans(n, rule, t)).otherwise(none) if n in asked else _spans(n, rule, t)
        for n, rule in enumerate(rules)]
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(kinds[s["place"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # Unpacked from a list of one, so that filters on the spans stay above the search.
    found = rows.select("row", F.inline(F.array(F.struct(spans.alias("spans")))))
    return found.select(*(F.col(f"row.`{c}`") for c in kept), "spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
