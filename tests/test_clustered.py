"""Reports of some parties read some files, and equal the whole report cut down."""

from pyspark.sql import functions as F

from conftest import SMALL, same
from tradeledger.plans import balances, ledgers
from tradeledger.sources import clustered, conform

NAMES = ["orders", "grass", "kasbons", "payments", "order_details", "grass_details"]


def test_reports_of_a_key_set(spark, tmp_path):
    t = conform.load(spark, SMALL)
    base = str(tmp_path)
    clustered.write(t, base, NAMES, 12)
    for keys in ([3], [3, 4, 90], [10_000_000], []):
        customers = spark.createDataFrame([(k,) for k in keys], "id bigint")
        some = clustered.tables_of(t, base, NAMES, customers)
        for report in (ledgers.customer_line_ledger, ledgers.customer_doc_ledger, balances.customer_balance):
            whole = report(t)
            assert same(report(some), whole.join(customers, whole.customer_id == customers.id, "left_semi").select(*whole.columns)) >= 0
        assert all(len(clustered.files_of(spark, base, n, customers)) <= 2 * len(keys) for n in NAMES if n not in clustered.LINES)


def test_only_files_of_the_keys_are_listed(spark, tmp_path):
    t = conform.load(spark, SMALL)
    clustered.write(t, str(tmp_path), ["orders"], 12)
    index = {r.file: (r.first, r.last) for r in spark.read.parquet(f"{tmp_path}/_index/orders").collect()}
    assert len(index) > 6
    for k in (1, 40, 149):
        got = clustered.files_of(spark, str(tmp_path), "orders", spark.createDataFrame([(k,)], "id bigint"))
        assert got == sorted(f for f, (a, b) in index.items() if a <= k <= b)
        held = t.orders.where(F.col("customer_id") == k).count()
        if got:
            assert spark.read.parquet(*got).where(F.col("customer_id") == k).count() == held
        else:
            assert held == 0
