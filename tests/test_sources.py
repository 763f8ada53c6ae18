"""Text load, sinks, naming, listings and date rules."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from conftest import SMALL, same
from tradeledger.functions import dates, text as texts
from tradeledger.operators import catalog
from tradeledger.plans import profit
from tradeledger.sources import conform, sinks, tables, text


def test_text_round_trip(spark, tmp_path):
    shape = T.StructType.fromDDL("id bigint, note string, amount decimal(12,2), day timestamp, flag boolean")
    rows = [(1, "tab\there", Decimal("1.50"), datetime(2022, 1, 2, 3, 4, 5), True), (2, "", None, None, False),
            (3, None, Decimal("-2.00"), None, None), (4, "back\\slash \\N \\t end\nline\rfeed", None, None, None),
            (5, "\\", None, None, None)]
    df = spark.createDataFrame(rows, shape)
    text.save_tsv(df, str(tmp_path / "out"))
    assert same(text.load_tsv(spark, str(tmp_path / "out"), shape), df) == 5


def test_text_marks(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("7\ta\\\\tb\t\\N\n8\t\\N\tt\n\\.\n")
    got = text.load_tsv(spark, str(tmp_path / "in.tsv"), T.StructType.fromDDL("id bigint, a string, b boolean")).collect()
    assert [tuple(r) for r in got] == [(7, "a\\tb", None), (8, None, True)]


def test_camel_case(seed):
    assert texts.camel("first_stock") == "firstStock" and texts.camel("id") == "id"
    row = json.loads(texts.json_rows(seed.products.where("id = 7")).first()["value"])
    assert row["firstStock"] == 90.0 and row["updateNotif"] is True and row["categoryId"] == 1


def test_epoch(spark):
    row = spark.sql("SELECT 1637600000L AS s").select(dates.from_epoch("s").alias("day")).first()
    assert row["day"] == datetime(2021, 11, 22, 16, 53, 20)


def test_last_minute_of_a_day_is_outside(spark, seed):
    days = ["2021-12-06 00:00:00", "2021-12-06 23:59:00", "2021-12-06 23:59:01", "2021-12-05 23:59:59", "2021-12-07 00:00:00"]
    orders = spark.createDataFrame([(i, 1, datetime.fromisoformat(d)) for i, d in enumerate(days)],
                                   "id bigint, customer_id bigint, order_date timestamp")
    kept = orders.where(dates.within_days("order_date", "2021-12-06T11:00", "2021-12-06"))
    assert sorted(r["id"] for r in kept.collect()) == [0, 1]
    lines = seed.order_details.limit(1).withColumn("order_id", F.expr("explode(sequence(0L, 4L))"))
    t = seed.having(orders=orders, order_details=lines)
    retail = "order_type = 0"
    assert sorted(r["id"] for r in profit.profit_by_order(t, "2021-12-06").where(retail).collect()) == [0, 1]
    assert sorted((r["order_day"], r["id"]) for r in profit.profit_by_order(t).where(retail).collect()) == [
        ("2021-12-06", 0), ("2021-12-06", 1), ("2021-12-07", 4)]
    assert len({r["id"] for r in profit.profit_lines(t, "2021-12-06", "2021-12-06", profit.RETAIL).collect()}) == 2


def test_bounds_must_be_dates():
    with pytest.raises(ValueError):
        dates.within_days("x", "1' OR '1'='1", None)


def test_period_filter_reaches_the_scan(spark):
    t = conform.load(spark, SMALL)
    plan = profit.profit_by_day(t, 1996, 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_party_filter_reaches_the_scan(spark):
    from tradeledger.plans import ledgers
    t = conform.load(spark, SMALL)
    plan = ledgers.customer_doc_ledger(t).where("customer_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(o_custkey,3)") >= 2 and plan.count("EqualTo(user_id,3)") >= 2


def test_unused_line_ids_cost_nothing(spark):
    t = conform.load(spark, SMALL)
    plan = profit.profit_by_day(t)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_page(seed):
    ids = [r["id"] for r in catalog.page(seed.products, "name", skip=1, take=2).collect()]
    assert ids == [15, 16]
    plan = catalog.page(seed.products, "name", 40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=60, offset=40" in plan


def test_by_keys(spark, seed):
    keys = spark.createDataFrame([(7,), (23,), (99,)], "product_id bigint")
    assert {r["id"] for r in catalog.by_keys(seed.products, keys).collect()} == {7, 23}
    assert {r["id"] for r in catalog.by_keys(seed.units, keys, "product_id").collect()} == {1, 2, 25, 27}


def test_product_without_units_is_listed(spark, seed):
    none = seed.units.where("product_id <> 7")
    got = {r["id"]: r["units"] for r in catalog.product_units(seed.products, none).collect()}
    assert got[7] is None and len(got[1]) == 3


def test_append_and_snapshot(spark, seed, tmp_path):
    path = str(tmp_path / "lines")
    sinks.append_rows(seed.order_details.where("order_id = 46"), path, ["order_id"])
    sinks.append_rows(seed.order_details.where("order_id <> 46"), path, ["order_id"])
    assert spark.read.parquet(path).count() == 9
    first = sinks.write_snapshot(seed.products, str(tmp_path / "products"), 1)
    second = sinks.write_snapshot(spark.read.parquet(first).where("id <> 7"), str(tmp_path / "products"), 2)
    assert spark.read.parquet(first).count() == 5 and spark.read.parquet(second).count() == 4


def test_staged_in_the_shared_folder(spark, seed):
    assert sinks.staging_path(spark, "x").startswith(sinks.shared_folder(spark))
    assert same(sinks.staged(seed.orders, "orders"), seed.orders) == 5


def test_clustered_files_keep_all_rows_and_model_reads_back(spark, tmp_path, seed):
    tables.write_clustered(seed.order_details, str(tmp_path / "order_details"), ["product_id", "id"], 3)
    back = tables.read_tables(spark, str(tmp_path)).order_details
    assert same(back, seed.order_details) == 9


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, seed):
    for name, key in (("order_details", "order_id"), ("orders", "id")):
        tables.save_bucketed(getattr(seed, name), f"bucketed_{name}", key, 4, str(tmp_path / name))
    lines, heads = spark.table("bucketed_order_details"), spark.table("bucketed_orders").withColumnRenamed("id", "order_id")
    joined = lines.hint("merge").join(heads, "order_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 9
    for name in ("order_details", "orders"):
        spark.sql(f"DROP TABLE bucketed_{name}")


def test_readers_see_the_published_version(spark, seed, tmp_path):
    from tradeledger.sources.tables import read_published
    base = str(tmp_path / "customers")
    with pytest.raises(ValueError):
        sinks.current_path(spark, base)
    sinks.write_snapshot(seed.customers, base, 1)
    seed.customers.limit(1).write.parquet(f"{base}/version=2")          # a write that never came to its end
    assert read_published(spark, str(tmp_path)).customers.count() == seed.customers.count()
    sinks.write_snapshot(seed.customers.limit(1), base, 2)
    assert read_published(spark, str(tmp_path)).customers.count() == 1
    assert spark.read.parquet(f"{base}/version=1").count() == seed.customers.count()


@pytest.mark.parametrize("moment,inside", [("23:59:00", True), ("23:59:00.000001", False), ("23:59:00.5", False), ("00:00:00", True)])
def test_the_last_minute_ends_sharply(spark, moment, inside):
    row = spark.sql(f"SELECT timestamp_ntz '2024-01-02 {moment}' AS at")
    assert row.where(dates.before_last_minute("at")).count() == inside
    assert row.where(dates.within_days("at", "2024-01-02", "2024-01-02")).count() == inside


def test_no_share_is_too_large(spark):
    from tradeledger.functions.money import kept_share
    row = spark.sql("SELECT 100.00 AS s, 9999999999.99 AS d, 0.00 AS x, 0.01 AS n, 60.00 AS t")
    got = row.selectExpr(f"{kept_share('s', 'd', 'x', 'n')} AS a", f"{kept_share('s', 't', 'x', 's')} AS b", f"{kept_share('s', 'd', 'x', 'x')} AS c").first()
    assert (float(got.a), float(got.b), float(got.c)) == (100 - 100 * 999999999999.0, 40.0, 100.0)


def test_every_escape_of_the_text_format(spark, tmp_path):
    marks = [r"a\bb\fc\vd", r"\101\x42\60", r"\303\251t\303\251", r"\\t \\\t", "\\q\\"] + ["\u0001 held"]
    path = str(tmp_path / "escapes")
    spark.createDataFrame([(f"{i}\t{m}",) for i, m in enumerate(marks)], "value string").write.text(path)
    got = text.load_tsv(spark, path, T.StructType.fromDDL("id int, note string")).orderBy("id").collect()
    assert [r["note"] for r in got] == ["a\bb\fc\vd", "AB0", "\u00e9t\u00e9", "\\t \\\t", "q\\", "\u0001 held"]
    df = spark.createDataFrame([(1, "\b\f\v\t\\101")], "id int, note string")
    text.save_tsv(df, path + "2")
    assert same(text.load_tsv(spark, path + "2", df.schema), df) == 1


@pytest.mark.parametrize("master, warehouse, default, named, ok", [
    ("local[4]", "file:/tmp/w", "file:///", None, True), ("yarn", "file:/tmp/w", "hdfs://a", None, False), ("yarn", "/w", "file:///", None, False),
    ("yarn", "/w", "hdfs://a", None, True), ("yarn", "hdfs://a/w", "file:///", None, True), ("yarn", "file:/tmp/w", "file:///", "hdfs://a/c", True)])
def test_staging_on_the_drivers_disk_is_refused_on_a_cluster(master, warehouse, default, named, ok):
    from types import SimpleNamespace as Named

    conf = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": named}
    session = Named(conf=Named(get=lambda k, *d: conf[k]), sparkContext=Named(master=master),
                    _jsc=Named(hadoopConfiguration=lambda: Named(get=lambda k: default)))
    if ok:
        assert sinks.shared_folder(session) == (named or f"{warehouse}/_staging")
    else:
        with pytest.raises(ValueError):
            sinks.shared_folder(session)


def test_every_line_is_sound_or_rejected_with_its_place(spark, tmp_path):
    shape = T.StructType.fromDDL("id bigint not null, name varchar(5) not null, price decimal(6,2), kind string")
    good = ["1\ta\t1.50\tx", "2\ta\\tb\t\\N\t\\N", "3\t\t0\ty", "4\tc\\303\\251\t7\tx"]
    bad = {"5\ta\t1": ["fields"], "": ["fields"], "6\ta\t1\tx\tz": ["fields"], "\\N\ta\t1\tx": ["id: null"], "x\t\\N\tq\tx": ["id: type", "name: null", "price: type"],
           "7\ttoolong\t1\tx": ["name: length"], "8\ta\\\t1\tx": ["name: escape"], "9\t\\xFF\t1\tx": ["name: escape"], "10\ta\t1\tw": ["kind: domain"], "11\ta\t99999\tx": ["price: type"],
           "12\ta\t1\tx\\": ["kind: escape"], "13\ta\\\\\\\t1\tx": ["name: escape"]}
    lines = [*good, *bad] * 40
    half = len(lines) // 2 + 3
    for name, part in (("a.tsv", lines[:half]), ("b.tsv", lines[half:])):
        (tmp_path / name).write_text("".join(x + "\n" for x in part) + END + "\n", "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        checked = text.checked_tsv(spark, str(tmp_path), shape, {"kind": ("x", "y")})
        rejected = text.rejected_lines(checked).collect()
        sound = sorted(map(tuple, text.sound_rows(checked).collect()), key=str)
        assert checked.rdd.getNumPartitions() > 3
        balance = {r.reason: r.n for r in text.load_balance(checked).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    places = [("a.tsv", k + 1, x) for k, x in enumerate(lines[:half])] + [("b.tsv", k + 1, x) for k, x in enumerate(lines[half:])]
    assert sorted((r.file.split("/")[-1], r.line, r.value, tuple(r.reasons)) for r in rejected) == sorted((f, k, x, tuple(bad[x])) for f, k, x in places if x in bad)
    assert sound == sorted([(1, "a", Decimal("1.50"), "x"), (2, "a\tb", None, None), (3, "", Decimal("0.00"), "y"), (4, "cé", Decimal("7.00"), "x")] * 40, key=str)
    assert balance[""] + len(rejected) == balance["all"] == len(lines) and balance["fields"] == 120


END = "\\."
