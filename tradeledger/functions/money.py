"""Decimal arithmetic shared by every report.  Money is never a double.

Formulas are SQL text: one call into the engine per column, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column

LINE = "decimal(12,2)"     # one stored amount
QTY = "decimal(10,2)"      # one stored quantity
MONEY = "decimal(18,2)"    # a computed amount of one line or one document (still a long inside)
TOTAL = "decimal(28,2)"    # sums over a party, a product, a period


def cents(column: Column, to: str = MONEY) -> Column:
    """Round half away from zero to two decimals."""
    return column.cast(to)


def rounded(formula: str, to: str = MONEY) -> str:
    return f"CAST({formula} AS {to})"


def nought(to: str = MONEY) -> str:
    return f"CAST(0 AS {to})"


def summed(formula: str) -> str:
    """``sum`` with one result type everywhere."""
    return f"CAST(sum({formula}) AS {TOTAL})"


def kept_share(subtotal: str, share: str, cost: str, net: str) -> str:
    """What a purchase line leaves to the seller after profit share and costs.

    ``subtotal * (1 - (share + cost) / (net + cost))``.  The ratio keeps 19
    decimals and every later step is exact, so sums can be rounded at the end.
    Where the ratio is too large for that (share and costs of 100,000 times the
    net), the line is multiplied before it is divided and keeps 7 decimals.
    A document worth nothing keeps the whole line.
    """
    line, taken, worth = f"CAST({subtotal} AS {LINE})", f"(CAST({share} AS {MONEY}) + CAST({cost} AS {MONEY}))", f"(CAST({net} AS {MONEY}) + CAST({cost} AS {MONEY}))"
    ratio = f"TRY_CAST(coalesce(try_divide({taken}, {worth}), 0) AS decimal(24,19))"
    return f"coalesce({line} - {line} * {ratio}, CAST({line} - try_divide({line} * {taken}, {worth}) AS decimal(38,21)))"
