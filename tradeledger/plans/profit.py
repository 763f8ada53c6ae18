"""Profit reports over retail and wholesale sales.

Margin per unit is the price less the buying price; retail also loses the
discount.  ``subtotal`` is the margin before the discount except in
``profit_lines``, where it is the profit of the line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeledger.functions.dates import before_last_minute, day_text, in_period, within_days
from tradeledger.functions.money import LINE, TOTAL, nought, rounded, summed

# Sale types of ``profit_lines``; any other number means both.
RETAIL, WHOLESALE, BOTH = 1, 2, 0

_UNIT_PROFIT = "price - buy_price - discount"

# The five amounts of a sale line.
AMOUNTS = {
    "buy_price": "buy_price * qty",
    "sale_price": "price * qty",
    "subtotal": "(price - buy_price) * qty",
    "discount": "discount * qty",
    "profit": f"({_UNIT_PROFIT}) * qty",
}


def _retail(t) -> tuple[int, DataFrame, DataFrame]:
    """Order type, lines with a discount, headers with a date."""
    return 0, t.order_details, t.columns("orders", "id", "customer_id", "order_date")


def _wholesale(t) -> tuple[int, DataFrame, DataFrame]:
    return (1, t.special_details.withColumn("discount", F.expr(nought(LINE))),
            t.columns("special_orders", "id", "customer_id", "created_at").withColumnRenamed("created_at", "order_date"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profit_lines(t, date_from: str | None = None, date_to: str | None = None, sale_type: int = BOTH) -> DataFrame:
    """Profit per line of the sales in a range of days; ``profit`` is per unit."""
    names = t.products.selectExpr("id AS product_id", "name", "spec")
    parts = []
    for side in {RETAIL: [_retail], WHOLESALE: [_wholesale]}.get(sale_type, [_retail, _wholesale]):
        _, lines, heads = side(t)
        dated = heads.where(within_days("order_date", date_from, date_to)).selectExpr("id AS order_id", "order_date")
        parts.append(lines.join(dated, "order_id").join(names, "product_id").selectExpr(
            "order_id AS id", "id AS line_id", "order_date", "name", "spec", "buy_price", "price AS sale_price",
            "discount", f"{rounded(_UNIT_PROFIT)} AS profit", "qty", "unit_name AS unit",
            f"{rounded(f'({_UNIT_PROFIT}) * qty')} AS subtotal"))
    return _union(parts)


def _per_order(lines: DataFrame, heads: DataFrame, narrow: bool, sums: dict[str, str]) -> DataFrame:
    """``sums`` per order, joined to the order's header.

    Without a date bound the lines are summed first, so one row per order is
    shuffled to the join and a huge order is no hot key.  With a bound the few
    matching headers pick their lines first.
    """
    if narrow:
        lines = lines.join(heads.selectExpr("id AS order_id"), "order_id", "left_semi")
    per_order = lines.groupBy("order_id").agg(*[F.expr(f"sum({f}) AS {n}") for n, f in sums.items()])
    return per_order.join(heads.withColumnRenamed("id", "order_id"), "order_id")


def profit_by_order(t, day: str | None = None) -> DataFrame:
    """Profit per order of one day, or of every day; rounded after summing.

    Nothing is rounded before, so margins are differences of exact sums.
    """
    names = t.customers.selectExpr("id AS customer_id", "name AS customer_name")
    parts = []
    for kind, lines, heads in (_retail(t), _wholesale(t)):
        heads = heads.where(within_days("order_date", day, day) if day else before_last_minute("order_date"))
        exact = {"bought": AMOUNTS["buy_price"], "sold": AMOUNTS["sale_price"]}
        if kind == 0:
            exact["reduced"] = AMOUNTS["discount"]
        reduced = "reduced" if kind == 0 else nought()
        shown = {"buy_price": "bought", "sale_price": "sold", "subtotal": "sold - bought", "discount": reduced,
                 "profit": f"sold - bought - {reduced}"}
        parts.append(_per_order(lines, heads, day is not None, exact).join(names, "customer_id").selectExpr(
            f"{day_text('order_date')} AS order_day", "order_id AS id", f"{kind}L AS order_type", "customer_name",
            *[f"{rounded(f, TOTAL)} AS {n}" for n, f in shown.items()]))
    return _union(parts)


def _by_date(t, year: int | None, month: int, keys: dict[str, str]) -> DataFrame:
    """Sums of line amounts (each rounded) grouped by something of the order date."""
    parts = []
    for kind, lines, heads in (_retail(t), _wholesale(t)):
        dated = heads.where(in_period("order_date", year, month)).select("id", "order_date")
        sums = {n: rounded(f) for n, f in AMOUNTS.items()}
        shown = {n: n for n in AMOUNTS}
        if kind == 1:   # no discount, so the profit is the margin
            del sums["discount"], sums["profit"]
            shown.update(discount=nought(TOTAL), profit="subtotal")
        parts.append(_per_order(lines, dated, year is not None, sums).selectExpr(
            *[f"{formula} AS {name}" for name, formula in [*keys.items(), *shown.items()]]))
    return _union(parts).groupBy(*keys).agg(*[F.expr(f"{summed(name)} AS {name}") for name in AMOUNTS])


def profit_by_day(t, year: int | None = None, month: int = 0) -> DataFrame:
    """Profit per calendar day of a month, a year (month 0) or all time (no year)."""
    return _by_date(t, year, month, {
        "id": "CAST(day(order_date) AS bigint)", "order_date": day_text("order_date")}).orderBy("id", "order_date")


def profit_by_month(t, year: int | None = None, month: int = 0) -> DataFrame:
    """Profit per month of a year, or of all years."""
    return _by_date(t, year, month, {
        "year": "CAST(year(order_date) AS bigint)", "id": "CAST(month(order_date) AS bigint)"}).orderBy("year", "id")


def profit_of_order(t, order_type: int = 0, orders: DataFrame | None = None) -> DataFrame:
    """Lines of orders with the profit of the line; ``orders(id)`` picks some of them.

    Type 0 is retail, anything else wholesale.  References guarantee that every
    line has its header, so the header is not read.
    """
    _, lines, _ = _retail(t) if order_type == 0 else _wholesale(t)
    if orders is not None:
        lines = lines.join(orders.selectExpr("id AS order_id"), "order_id", "left_semi")
    names = t.products.selectExpr("id AS product_id", "name AS product_name")
    return lines.join(names, "product_id").selectExpr(
        "order_id", "id", "product_name", "buy_price", "price AS sale_price", "discount", "qty",
        "unit_name AS unit", f"{rounded(f'({_UNIT_PROFIT}) * qty')} AS profit")
