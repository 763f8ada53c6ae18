"""Date ranges as pushable predicates, and date formatting.

All functions return SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def within_days(column: str, date_from: str | None, date_to: str | None) -> str:
    """``date_from 00:00:00 <= column <= date_to 23:59:00``, both ends optional.

    Only the first ten characters of a bound count.  The upper end stops at
    23:59:00 sharp, so the last 59 seconds of a day are outside.  The bounds
    take the column's own type and reach the file scan.
    """
    bounds = []
    if date_from is not None:
        bounds.append(f"{column} >= '{_day(date_from)} 00:00:00'")
    if date_to is not None:
        bounds.append(f"{column} <= '{_day(date_to)} 23:59:00'")
    return " AND ".join(bounds) or "true"


def _day(text: str) -> str:
    """The date part of a bound; anything else than digits and dashes is refused."""
    day = text[:10]
    if not day.replace("-", "").isdigit():
        raise ValueError(f"not a date: {text!r}")
    return day


def before_last_minute(column: str) -> str:
    """The same upper end, for every day at once."""
    return f"date_format({column}, 'HH:mm:ss.SSSSSS') <= '23:59:00.000000'"


def in_period(column: str, year: int | None, month: int = 0) -> str:
    """Year, or year and month, as a half-open range instead of ``year(x) = y``."""
    if year is None:
        return f"month({column}) = {month:d}" if month else "true"
    first, last = f"{year:04d}-01-01", f"{year + 1:04d}-01-01"
    if month:
        first = f"{year:04d}-{month:02d}-01"
        last = f"{year:04d}-{month + 1:02d}-01" if month < 12 else last
    return f"{column} >= '{first} 00:00:00' AND {column} < '{last} 00:00:00'"


def day_text(column: str) -> str:
    return f"date_format({column}, 'yyyy-MM-dd')"


def day_first(column: str) -> str:
    return f"date_format({column}, 'dd-MM-yyyy')"


def from_epoch(seconds: Column | str) -> Column:
    """Seconds since 1970-01-01 UTC as a timestamp."""
    return F.timestamp_seconds(seconds)
