"""Settlements: closing a customer's open items, changing and revoking that.

``lunas_id`` 0 marks open items.  What remains unpaid at a settlement is carried
over as an advance due seven days later, found by ``ref_lunas_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeledger.functions.text import joined
from tradeledger.operators.running import HOT_ROWS, following
from tradeledger.sources.tables import Tables

c = F.col

# The tables a settlement closes items in, and the carried-over term.
STAMPED = ("orders", "special_orders", "payments", "special_payments", "kasbons", "grass")
TERM = "INTERVAL 7 DAYS"


def _carry_over(settlements: DataFrame, like: DataFrame, new_id: Column, closed_by: Column) -> DataFrame:
    fields = {
        "id": new_id, "customer_id": c("customer_id"),
        "descriptions": joined("Saldo piutang pelunasan ID #", c("id")),
        "kasbon_date": c("created_at"), "jatuh_tempo": c("created_at") + F.expr(TERM),
        "total": c("remain_payment"), "lunas_id": closed_by, "ref_lunas_id": c("id"),
    }
    types = dict(like.dtypes)
    return settlements.where(c("remain_payment") > 0).select(
        *[fields[n].cast(types[n]).alias(n) for n in like.columns])


def _with_next(settlements: DataFrame, hot_rows: int) -> DataFrame:
    """Adds ``_next``: the customer's next settlement id, null for the last."""
    return following(settlements, ["customer_id"], "id", "_next", hot_rows)


def apply_settlements(t: Tables, settlements: DataFrame, new_id: Column, hot_rows: int = HOT_ROWS) -> Tables:
    """Close all open items of the settled customers; carry over what remains.

    Several settlements of one customer take effect in id order: the first
    closes all open items, each later one closes the previous carry-over.
    """
    first = settlements.groupBy("customer_id").agg(F.min("id").alias("_first"))
    closed = {}
    for name in STAMPED:
        table = getattr(t, name)
        number = F.when((c("lunas_id") == 0) & c("_first").isNotNull(), c("_first")).otherwise(c("lunas_id"))
        closed[name] = table.join(first, "customer_id", "left").select(
            *[number.alias(n) if n == "lunas_id" else c(n) for n in table.columns])
    carried = _carry_over(_with_next(settlements, hot_rows), t.kasbons, new_id, F.coalesce(c("_next"), F.lit(0)))
    closed["kasbons"] = closed["kasbons"].unionByName(carried)
    return t.having(**closed)


def amend_settlements(kasbons: DataFrame, settlements: DataFrame, new_id: Column) -> DataFrame:
    """Advances after ``settlements`` changed: carry-overs are updated, added or removed."""
    new = settlements.select(
        c("id").alias("ref_lunas_id"), c("customer_id").alias("_customer"), c("remain_payment").alias("_remain"),
        c("created_at").alias("_day"))
    types = dict(kasbons.dtypes)
    remains = c("_remain") > 0
    # most advances carry nothing over; they stay out of the join, where they would be one hot key
    plain = kasbons.where("coalesce(ref_lunas_id, 0) = 0")
    fresh = {"total": c("_remain"), "kasbon_date": c("_day"), "jatuh_tempo": c("_day") + F.expr(TERM)}
    kept = kasbons.where("ref_lunas_id <> 0").join(new, "ref_lunas_id", "left").where(
        c("_remain").isNull() | remains | (c("customer_id") != c("_customer"))
    ).select(*[F.when(remains, fresh[n]).otherwise(c(n)).cast(types[n]).alias(n) if n in fresh else c(n)
               for n in kasbons.columns])
    carried = kasbons.where("ref_lunas_id <> 0").select(c("ref_lunas_id").alias("id"))
    missing = settlements.join(carried, "id", "left_anti")
    return plain.unionByName(kept).unionByName(_carry_over(missing, kasbons, new_id, F.lit(0)))


def revoke_settlements(t: Tables, settlements: DataFrame) -> Tables:
    """Reopen everything the settlements closed and drop their carry-overs."""
    gone = settlements.select("customer_id", c("id").alias("lunas_id"), F.lit(True).alias("_gone"))
    carried = settlements.select("customer_id", c("id").alias("ref_lunas_id"))
    reopened = {}
    for name in STAMPED:
        table = getattr(t, name)
        columns = table.columns
        if name == "kasbons":
            kept = table.where("ref_lunas_id <> 0").join(carried, ["customer_id", "ref_lunas_id"], "left_anti")
            table = table.where("coalesce(ref_lunas_id, 0) = 0").unionByName(kept.select(*columns))
        number = F.when(c("_gone"), F.lit(0)).otherwise(c("lunas_id"))
        reopened[name] = table.join(gone, ["customer_id", "lunas_id"], "left").select(
            *[number.cast("bigint").alias(n) if n == "lunas_id" else c(n) for n in columns])
    return t.having(**reopened)
