"""Text building and field naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def joined(*parts: Column | str) -> Column:
    """Concatenation that skips nulls (plain ``concat`` would return null)."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in rest)


def camel_fields(df: DataFrame) -> DataFrame:
    """Rename ``snake_case`` columns to ``camelCase`` for consumers of JSON."""
    return df.withColumnsRenamed({c: camel(c) for c in df.columns})


def json_rows(df: DataFrame) -> DataFrame:
    """One camelCase JSON document per row, ready for ``write.text``."""
    out = camel_fields(df)
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))
