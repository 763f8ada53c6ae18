"""Applying sets of inserts, updates and deletes to a table.

Keys in a change set are unique; ``quality.duplicates`` finds those that are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeledger import schema

_HIT = "_matched"


def apply_inserts(table: DataFrame, rows: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Old rows plus the new ones, absent or null columns filled from ``defaults``.

    Rows whose key is taken are left out; ``rejected_inserts`` returns them.
    """
    return table.unionByName(_shaped(rows, table, defaults or {}).join(table.select(key), key, "left_anti"))


def rejected_inserts(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_semi")


def _shaped(rows: DataFrame, table: DataFrame, defaults: dict) -> DataFrame:
    columns = []
    for f in table.schema:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name in defaults:
            default = defaults[f.name]
            value = F.coalesce(value.cast(f.dataType),
                               (F.current_timestamp() if default == schema.NOW else F.lit(default)).cast(f.dataType))
        columns.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def apply_updates(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Replace the columns named in ``changes`` where the key matches; null is a value."""
    fields = [n for n in changes.columns if n != key]
    new = changes.select(key, *[F.col(n).alias(f"_new_{n}") for n in fields], F.lit(True).alias(_HIT))
    types = dict(table.dtypes)
    return table.join(new, key, "left").select(*[
        F.when(F.col(_HIT), F.col(f"_new_{n}")).otherwise(F.col(n)).cast(types[n]).alias(n) if n in fields
        else F.col(n)
        for n in table.columns
    ])


def updated_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The changed rows only, as they are after the update."""
    return apply_updates(table.join(changes.select(key), key, "left_semi"), changes, key)


def apply_deletes(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def deleted_ids(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_semi").select(key)


def insert_products(products: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after the insert, and the inserted rows in their returned shape."""
    after = apply_inserts(products, rows, "id", schema.DEFAULTS["products"])
    shown = _shaped(rows, products, schema.DEFAULTS["products"]).join(products.select("id"), "id", "left_anti")
    return after, shown.select("id", "category_id", "name", "spec", "price", "stock", "first_stock", "unit")


def insert_units(units: DataFrame, rows: DataFrame) -> DataFrame:
    """New units never start as the default one."""
    return apply_inserts(units, rows.withColumn("is_default", F.lit(False)), "id", schema.DEFAULTS["units"])


def set_default_units(units: DataFrame, choices: DataFrame) -> DataFrame:
    """``choices(product_id, unit_id)``: that unit becomes the product's only default.

    A choice that names no unit of its product leaves the product without one.
    """
    chosen = choices.select("product_id", F.col("unit_id").alias("_chosen"))
    picked = F.when(F.col("_chosen").isNotNull(), F.col("id") == F.col("_chosen")).otherwise(F.col("is_default"))
    return units.join(chosen, "product_id", "left").select(
        *[picked.alias(n) if n == "is_default" else F.col(n) for n in units.columns])


def change_set(table: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Old and new side by side: ``key``, ``op``, ``old_*``, ``new_*``.

    ``edits`` has ``op`` (``I``, ``U``, ``D``), the key and the new values.  Old
    values come from ``table``; an insert has none and a delete has no new ones.
    Edits that cannot apply (insert of a taken key, change of an absent row) drop out.
    """
    fields = [n for n in edits.columns if n not in (key, "op")]
    old = table.select(key, *[F.col(n).alias(f"old_{n}") for n in fields], F.lit(True).alias(_HIT))
    keep = F.col("op") != "D"
    new = edits.select(key, "op", *[F.when(keep, F.col(n)).alias(f"new_{n}") for n in fields])
    found = F.coalesce(F.col(_HIT), F.lit(False))
    # The whole table never goes through the driver to every task, however small its files are.
    return new.join(old.hint("merge"), key, "left").where((F.col("op") == "I") != found).drop(_HIT)
