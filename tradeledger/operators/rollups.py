"""Totals of parents that follow from their children.

Each rollup has a full form (recompute from all children) and a delta form
(adjust stored totals by a change set).  The delta form takes a change set with
``old_*`` and ``new_*`` columns: the old value leaves the old parent, the new
value enters the new one, so moved children leave both parents right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeledger.functions.money import LINE, MONEY, TOTAL, nought, rounded, summed

c = F.col


# ---- building blocks ---------------------------------------------------

def child_sums(children: DataFrame, parent: str, **sums: str) -> DataFrame:
    """One row per parent; summed map-side first, so a parent of any size is fine."""
    return children.groupBy(c(parent).alias("id")).agg(
        *[F.expr(f"{summed(v)} AS {n}") for n, v in sums.items()])


def with_sums(parents: DataFrame, sums: DataFrame) -> DataFrame:
    """Every parent id with its sums, 0 where it has no children."""
    names = [n for n in sums.columns if n != "id"]
    return parents.select("id").join(sums, "id", "left").selectExpr(
        "id", *[f"CAST(coalesce({n}, 0) AS {TOTAL}) AS {n}" for n in names])


def signed_changes(changes: DataFrame, parent: str, sign: int = 1, **values: str) -> DataFrame:
    """Sum of changes per parent, ``sign`` being +1 for what children add to it.

    ``values`` maps result columns to the child columns they come from.  Both
    sides of a change leave one scan as two rows; unchanged parents drop out.
    """
    def side(prefix: str, direction: int) -> str:
        fields = [f"'{name}', CAST({direction * sign} * {prefix}_{source} AS {MONEY})"
                  for name, source in values.items()]
        return f"named_struct('id', {prefix}_{parent}, {', '.join(fields)})"
    both = changes.selectExpr(f"inline(array({side('old', -1)}, {side('new', 1)}))").where("id IS NOT NULL")
    return child_sums(both, "id", **{name: name for name in values})


def apply_delta(parents: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored columns plus their change."""
    names = [n for n in delta.columns if n != "id"]
    moved = delta.selectExpr("id", *[f"{n} AS _d_{n}" for n in names])
    return parents.join(moved, "id", "left").selectExpr(*[
        f"CAST({n} + coalesce(_d_{n}, 0) AS {TOTAL}) AS {n}" if n in names else n for n in parents.columns])


# ---- documents ---------------------------------------------------------

def order_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return with_sums(orders, child_sums(lines, "order_id", total="subtotal"))


# Wholesale headers add up their lines the same way.
special_totals = order_totals


def stock_totals(stocks: DataFrame, lines: DataFrame) -> DataFrame:
    return with_sums(stocks, child_sums(lines, "stock_id", total="subtotal"))


def purchase_totals(purchases: DataFrame, lines: DataFrame, costs: DataFrame) -> DataFrame:
    """Quantity, and value net of costs."""
    both = lines.selectExpr("grass_id", f"{rounded('real_qty')} AS qty", f"{rounded('subtotal')} AS total").unionByName(
        costs.selectExpr("grass_id", f"{nought()} AS qty", f"{rounded('-subtotal')} AS total"))
    return with_sums(purchases, child_sums(both, "grass_id", qty="qty", total="total"))


def purchase_costs(purchases: DataFrame, costs: DataFrame) -> DataFrame:
    return with_sums(purchases, child_sums(costs, "grass_id", cost="subtotal"))


def stock_payments(stocks: DataFrame, payments: DataFrame) -> DataFrame:
    return with_sums(stocks, child_sums(payments, "stock_id", payments="nominal"))


def special_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return with_sums(orders, child_sums(payments, "order_id", payments="nominal"))


def order_totals_delta(orders: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_delta(orders, signed_changes(changes, "order_id", total="subtotal"))


special_totals_delta = order_totals_delta


def stock_totals_delta(stocks: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_delta(stocks, signed_changes(changes, "stock_id", total="subtotal"))


def purchase_totals_delta(purchases: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_delta(purchases, signed_changes(changes, "grass_id", qty="real_qty", total="subtotal"))


def purchase_costs_delta(purchases: DataFrame, changes: DataFrame) -> DataFrame:
    """A cost raises ``cost`` and lowers ``total`` by the same amount."""
    delta = signed_changes(changes, "grass_id", cost="subtotal").withColumn("total", F.expr(f"CAST(-cost AS {TOTAL})"))
    return apply_delta(purchases, delta)


def stock_payments_delta(stocks: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_delta(stocks, signed_changes(changes, "stock_id", payments="nominal"))


def special_payments_delta(orders: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_delta(orders, signed_changes(changes, "order_id", payments="nominal"))


# ---- stock on hand -----------------------------------------------------

# Which lines bring goods in (+1) and which take them out (-1).
DIRECTION = {"stock_details": 1, "grass_details": 1, "order_details": -1, "special_details": -1}


def stock_moves(tables) -> DataFrame:
    """Signed base quantities of all four line tables."""
    return reduce(DataFrame.unionByName, [
        getattr(tables, name).selectExpr("product_id", f"CAST({sign} * real_qty AS {MONEY}) AS moved")
        for name, sign in DIRECTION.items()])


def stock_on_hand(tables) -> DataFrame:
    """Opening stock plus everything received minus everything sold."""
    moved = child_sums(stock_moves(tables), "product_id", moved="moved")
    return tables.products.select("id", "first_stock").join(moved, "id", "left").selectExpr(
        "id", f"CAST(first_stock + coalesce(moved, 0) AS {TOTAL}) AS stock")


def stock_on_hand_delta(products: DataFrame, changes: dict[str, DataFrame]) -> DataFrame:
    """Stored stock adjusted by change sets of any of the four line tables."""
    parts = [signed_changes(ch, "product_id", DIRECTION[name], stock="real_qty") for name, ch in changes.items()]
    return apply_delta(products, child_sums(reduce(DataFrame.unionByName, parts), "id", stock="stock"))


def opening_stock_shift(products: DataFrame, openings: DataFrame) -> DataFrame:
    """``openings(id, first_stock)``: stock moves by the change of the opening stock."""
    new = openings.selectExpr("id", "first_stock AS _opening")
    return products.join(new, "id", "left").withColumns({
        "stock": F.expr(rounded("stock + coalesce(_opening, first_stock) - first_stock")),
        "first_stock": F.expr(rounded("coalesce(_opening, first_stock)")),
    }).drop("_opening")


def unit_price_refresh(units: DataFrame, prices: DataFrame) -> DataFrame:
    """``prices(id, price)`` of products: their units get new buying and selling prices."""
    new = prices.selectExpr("id AS product_id", f"CAST(price AS {LINE}) AS _base")
    fresh = {"buy_price": "_base * content", "price": "_base * content + _base * content * margin"}
    return units.join(new, "product_id", "left").selectExpr(*[
        f"IF(_base IS NOT NULL, {rounded(fresh[n])}, {rounded(n)}) AS {n}" if n in fresh else n
        for n in units.columns])
