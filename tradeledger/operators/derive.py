"""Columns that follow from other columns of the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeledger.functions.money import rounded

# The rules of each derived column.
REAL_QTY = rounded("qty * content")
NET_SUBTOTAL = rounded("qty * (price - discount)")
SUBTOTAL = rounded("qty * price")
ORDER_REMAINDER = rounded("total - payment")
STOCK_REMAINDER = rounded("total - (cash + payments)")
SPECIAL_REMAINDER = rounded("total - cash - payments")


def _with(df: DataFrame, **formulas: str) -> DataFrame:
    return df.withColumns({name: F.expr(formula) for name, formula in formulas.items()})


def order_lines(lines: DataFrame) -> DataFrame:
    """Base quantity, and the line value after the discount per unit."""
    return _with(lines, real_qty=REAL_QTY, subtotal=NET_SUBTOTAL)


# A receipt line from a supplier follows the same rule as a retail line.
stock_lines = order_lines


def special_lines(lines: DataFrame) -> DataFrame:
    """Base quantity and line value of lines without a discount."""
    return _with(lines, real_qty=REAL_QTY, subtotal=SUBTOTAL)


purchase_lines = special_lines


def purchase_costs(costs: DataFrame) -> DataFrame:
    return _with(costs, subtotal=SUBTOTAL)


def order_remainder(orders: DataFrame) -> DataFrame:
    return _with(orders, remain_payment=ORDER_REMAINDER)


def stock_remainder(stocks: DataFrame) -> DataFrame:
    return _with(stocks, remain_payment=STOCK_REMAINDER)


def special_remainder(orders: DataFrame, stamp: bool = True) -> DataFrame:
    """The remainder; ``stamp`` also moves ``updated_at`` to now."""
    out = _with(orders, remain_payment=SPECIAL_REMAINDER)
    if stamp and "updated_at" in out.columns:
        kind = dict(out.dtypes)["updated_at"]
        out = out.withColumn("updated_at", F.current_timestamp().cast(kind))
    return out
