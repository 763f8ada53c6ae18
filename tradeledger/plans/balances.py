"""Balance summaries: a few rows per party with a running total.

Each source is summed per party map-side; one shuffle brings a party's sums
together; the summary rows and their running total are then plain arithmetic.

Fixed values here are the titles of a balance's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeledger.functions.money import MONEY, TOTAL, nought, rounded, summed


def _summary(keys: list[str], keep_zero: bool, *rows: tuple[str, DataFrame, str, str]) -> DataFrame:
    """``rows`` are (title, frame with ``keys``, debt, cred), in output order.

    Without ``keep_zero`` a row needs a positive side to show and to count.
    """
    frames = [
        df.selectExpr(*keys, f"{i} AS row", f"{rounded(debt)} AS debt", f"{rounded(cred)} AS cred")
        for i, (_, df, debt, cred) in enumerate(rows)]
    used = [(i, side) for i, (_, _, debt, cred) in enumerate(rows)
            for side, formula in (("debt", debt), ("cred", cred)) if formula != "0"]
    sums = reduce(DataFrame.unionByName, frames).groupBy(*keys).agg(*[
        F.expr(f"CAST(coalesce(sum({side}) FILTER (WHERE row = {i}), 0) AS {TOTAL}) AS {side}{i}") for i, side in used])

    amount = lambda i, side: f"{side}{i}" if (i, side) in used else nought(TOTAL)
    structs, steps = [], []
    for i, (title, *_) in enumerate(rows):
        debt, cred = amount(i, "debt"), amount(i, "cred")
        shown = "true" if keep_zero else f"({debt} > 0 OR {cred} > 0)"
        steps.append(f"IF({shown}, {debt} - {cred}, 0)")
        structs.append(
            f"named_struct('id', {i + 1}L, 'descriptions', '{title}', 'debt', {debt}, 'cred', {cred}, "
            f"'balance', {rounded(' + '.join(steps), TOTAL)}, 'shown', {shown})")
    return sums.selectExpr(*keys, f"inline(array({', '.join(structs)}))").where("shown").drop("shown")


def customer_balance(t) -> DataFrame:
    """Sales, advances, purchases and instalments; empty rows are left out."""
    return _summary(
        ["customer_id", "lunas_id"], False,
        ("Piutang Barang", t.orders, "total", "payment"),
        ("Kasbon", t.kasbons, "total", "0"),
        ("Pembelian", t.grass, "0", "total - total_div"),
        ("Cicilan", t.payments, "0", "total"))


def special_balance(t) -> DataFrame:
    """Wholesale orders and instalments; every customer has both rows for open items."""
    everyone = t.customers.selectExpr("id AS customer_id", "0L AS lunas_id", f"{nought()} AS total", f"{nought()} AS cash")
    orders = t.special_orders.selectExpr(
        "customer_id", "lunas_id", f"CAST(total AS {MONEY}) AS total", f"CAST(cash AS {MONEY}) AS cash")
    return _summary(
        ["customer_id", "lunas_id"], True,
        ("Piutang Dagang", orders.unionByName(everyone), "total", "cash"),
        ("Angsuran", t.special_payments, "0", "nominal"))


def supplier_balance(t) -> DataFrame:
    """Receipts and their instalments; empty rows are left out."""
    paid = t.stock_payments.groupBy("stock_id").agg(F.expr(f"{summed('nominal')} AS nominal"))
    owner = t.columns("stocks", "id", "supplier_id").withColumnRenamed("id", "stock_id")
    return _summary(
        ["supplier_id"], False,
        ("Piutang Barang", t.stocks, "total", "cash"),
        ("Angsuran", paid.join(owner, "stock_id"), "0", "nominal"),
    ).select("supplier_id", "id", "descriptions", "cred", "debt", "balance")
