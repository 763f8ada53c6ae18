"""The payment row a partner gets for their share of a purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeledger.functions.money import MONEY
from tradeledger.functions.text import joined

c = F.col


def profit_share_payments(
    payments: DataFrame,
    purchases: DataFrame,
    customers: DataFrame,
    new_id: Column,
    deleted: DataFrame | None = None,
) -> DataFrame:
    """Payments after inserting or changing ``purchases`` (and deleting ``deleted(id)``).

    A purchase with a share has one payment to the partner, found by ``ref_id``:
    it is changed if there, else added.  Without a share it is removed.
    ``new_id`` gives the id of an added row from the purchase's ``id``.
    """
    # most payments belong to no purchase (reference 0 or null); they stay out of the joins, where they would be one hot key
    plain, payments = payments.where("coalesce(ref_id, 0) = 0"), payments.where("ref_id <> 0")
    if deleted is not None:
        gone = deleted.select(c("id").alias("ref_id"))
        payments = payments.join(gone, "ref_id", "left_anti").select(*payments.columns)
    sellers = customers.select(c("id").alias("customer_id"), c("name").alias("seller"))
    shares = purchases.join(sellers, "customer_id", "left").select(
        c("id").alias("ref_id"), new_id.alias("_id"), c("partner_id").alias("_customer_id"),
        joined("Bagi hasil dengan ", c("seller"), " (", F.format_number("qty", 0), " kg )").alias("_descriptions"),
        c("order_date").alias("_payment_date"), c("total_div").cast(MONEY).alias("_total"),
        F.lit(True).alias("_touched"))
    types = dict(payments.dtypes)

    touched = c("_touched").isNotNull()
    changed = ["customer_id", "descriptions", "payment_date", "total"]
    kept = payments.join(shares, "ref_id", "left").where(~touched | (c("_total") > 0)).select(*[
        F.when(touched, c(f"_{n}")).otherwise(c(n)).cast(types[n]).alias(n) if n in changed else c(n)
        for n in payments.columns])
    added = shares.where(c("_total") > 0).join(payments.select("ref_id"), "ref_id", "left_anti").select(
        "ref_id", F.lit(0).alias("lunas_id"), c("_id").alias("id"), *[c(f"_{n}").alias(n) for n in changed])
    return plain.unionByName(kept).unionByName(added.select(*[c(n).cast(types[n]).alias(n) for n in payments.columns]))
