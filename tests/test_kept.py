"""Bucketed stores and kept ledgers: only what changes is written, and results equal those made anew."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import same
from tradeledger.operators import cascade
from tradeledger.plans import kept
from tradeledger.sources import buckets
from tradeledger.sources.buckets import Conflict, Store

ITEMS = "id bigint, name string, amount decimal(12,2)"


def items(spark, rows):
    return spark.createDataFrame([(i, f"n{i}" if n is None else n, a) for i, n, a in rows], "id bigint, name string, amount int").withColumn("amount", F.col("amount").cast("decimal(12,2)"))


def edits(spark, rows):
    return spark.createDataFrame(rows, "op string, id bigint, name string")


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    table = items(spark, [(i, None, i) for i in range(2000)])
    assert store.version() == 0 and buckets.create(store, {"items": (table, ["id"], 64), "other": (table.limit(5), ["id"], 2)}) == 1
    assert same(store.read("items"), table) == 2000
    change = cascade.changes_of("items", store.read("items"), edits(spark, [("U", 7, "seven"), ("D", 9, None), ("I", 5000, "new"), ("I", 8, "taken"), ("U", 9999, "absent")]))
    before = store.parts(1)["items"].folders
    assert buckets.merge(store, {"items": change}) == 2
    after = store.parts(2)["items"].folders
    hit = {r[0] for r in items(spark, [(7, "", 0), (9, "", 0), (5000, "", 0)]).select(buckets.bucket(["id"], 64)).collect()}
    assert {b for b in before if before[b] != after.get(b)} == hit and store.parts(2)["other"] == store.parts(1)["other"]
    want = {i: (f"n{i}", i) for i in range(2000) if i != 9} | {7: ("seven", 7), 5000: ("new", None)}
    assert {r.id: (r.name, r.amount) for r in store.read("items").collect()} == want
    assert same(store.read("items", version=1), table) == 2000        # readers of the old version keep it


def test_random_merges_equal_a_dictionary(spark, tmp_path):
    rng, store = random.Random(4), Store(spark, str(tmp_path))
    want = {i: f"n{i}" for i in range(60)}
    buckets.create(store, {"items": (items(spark, [(i, n, 0) for i, n in want.items()]), ["id"], 7)})
    for step in range(4):
        batch = [(rng.choice("IUD"), i, f"s{step}") for i in rng.sample(range(90), 25)]
        buckets.merge(store, {"items": cascade.changes_of("items", store.read("items"), edits(spark, batch))})
        for op, i, name in batch:
            if (op == "I") == (i not in want):
                want = {k: v for k, v in want.items() if k != i} if op == "D" else want | {i: name}
        assert {r.id: r.name for r in store.read("items").collect()} == want
    gone = cascade.changes_of("items", store.read("items"), edits(spark, [("D", i, None) for i in want]))
    buckets.merge(store, {"items": gone})
    assert store.read("items").count() == 0 and store.read("items").columns == ["id", "name", "amount"]


def test_of_two_writers_one_publishes_and_a_broken_one_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    buckets.create(store, {"items": (items(spark, [(i, None, i) for i in range(50)]), ["id"], 4)})
    change = lambda name: cascade.changes_of("items", store.read("items", version=1), edits(spark, [("U", 1, name)]))
    assert buckets.merge(store, {"items": change("first")}, since=1) == 2
    with pytest.raises(Conflict):
        buckets.merge(store, {"items": change("second")}, since=1)
    assert store.version() == 2 and store.read("items").where("id = 1").first().name == "first"
    monkeypatch.setattr(Store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        buckets.merge(store, {"items": cascade.changes_of("items", store.read("items"), edits(spark, [("U", 1, "third")]))})
    monkeypatch.undo()
    assert store.version() == 2 and store.read("items").where("id = 1").first().name == "first"


SHAPE = kept.Shape(("party", "closed"), ("doc", "line"), (("n", "1"), ("balance", "debt - cred")))


def plain_ledger(rows):
    out, sums = [], {}
    for r in sorted(rows, key=lambda r: r[:4]):
        n, b = sums.get(r[:2], (0, 0))
        sums[r[:2]] = n + 1, b + r[4] - r[5]
        out.append((*r, *sums[r[:2]]))
    return out


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_a_kept_ledger_equals_one_made_anew(spark, tmp_path, hot_rows):
    rng, store = random.Random(hot_rows), Store(spark, str(tmp_path))
    shape = "party bigint, closed int, doc bigint, line bigint, debt int, cred int"
    row = lambda p, d, k: (p, p % 2, d, k, rng.randint(0, 99), rng.randint(0, 99))
    rows = {r[:4]: r for r in [row(1, d, k) for d in range(40) for k in range(3)] + [row(p, p, 0) for p in range(2, 40)]}
    kept.build(store, spark.createDataFrame(list(rows.values()), shape), SHAPE, 16, hot_rows)
    got = lambda: sorted(tuple(r) for r in kept.read(store, SHAPE).select("party", "closed", "doc", "line", "debt", "cred", F.col("n").cast("int"), F.col("balance").cast("int")).collect())
    assert got() == sorted(plain_ledger(rows.values()))
    for step in range(4):
        out = rng.sample(sorted(rows), 12)
        new = [row(1, rng.randint(0, 60), 10 + step) for _ in range(40 if step == 1 else 5)] + [row(rng.randint(1, 60), 100 + step, k) for k in range(6)] + [rows[k][:4] + (5, 6) for k in out[:4]]
        new = {r[:4]: r for r in new if r[:4] not in rows or r[:4] in out}
        files = dict(store.parts()[kept.ROWS].folders)
        kept.change(store, SHAPE, spark.createDataFrame([k for k in out] + [(77, 1, 0, 0)], "party bigint, closed int, doc bigint, line bigint"),
                    spark.createDataFrame(list(new.values()), shape), hot_rows)
        rows = {k: r for k, r in rows.items() if k not in out} | new
        assert got() == sorted(plain_ledger(rows.values()))
        if hot_rows == 10:
            assert len(set(files.values()) & set(store.parts()[kept.ROWS].folders.values())) > 0 or len(files) < 16
    if hot_rows == 10:
        assert store.read(kept.SUMMARY).agg(F.max("_rows")).first()[0] <= 60


def test_a_late_change_of_one_row_touches_one_chunk(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(3000).selectExpr("id % 3 AS party", "0 AS closed", "id AS doc", "0L AS line", "1 AS debt", "0 AS cred")
    kept.build(store, rows, SHAPE, 200, hot_rows=50)
    files = store.parts()[kept.ROWS].folders
    kept.change(store, SHAPE, rows.where("doc = 300").select("party", "closed", "doc", "line"), rows.where("doc = 300").withColumn("debt", F.lit(11)), hot_rows=50)
    after = store.parts()[kept.ROWS].folders
    assert sum(files[b] != after[b] for b in files) == 1
    last = kept.read(store, SHAPE).where("party = 0").agg(F.max_by("balance", "doc").alias("b"), F.max("n").alias("n")).first()
    assert (int(last.b), int(last.n)) == (1010, 1000)


def test_a_change_does_the_work_behind_its_rows_once(spark, tmp_path):
    store, shape = Store(spark, str(tmp_path)), kept.Shape(("party",), ("id",), (("balance", "amount"),))
    rows = spark.range(400).selectExpr("id % 5 AS party", "id", "id % 7 AS amount")
    kept.build(store, rows, shape, 4)
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    late = spark.range(1000, 1050).select((F.col("id") % 5).alias("party"), F.udf(noted, "bigint").asNondeterministic()("id").alias("id"), F.lit(1).cast("bigint").alias("amount"))
    kept.change(store, shape, rows.where("id < 20").select("party", "id"), late)
    assert seen.value == 50
    assert kept.read(store, shape).count() == 430
