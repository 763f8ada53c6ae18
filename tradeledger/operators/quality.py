"""The declared constraints as jobs over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tradeledger import schema
from tradeledger.functions.money import TOTAL

c = F.col


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- uniqueness --------------------------------------------------------

def duplicates(table: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where(c("n") > 1)


def dup_keys(t) -> DataFrame:
    """Per table: rows, and ids that occur more than once."""
    frames = []
    for name in schema.DDL:
        counted = getattr(t, name).groupBy("id").agg(F.count("*").alias("n"))
        frames.append(counted.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
            F.count_if(c("n") > 1).alias("n_dup_keys")
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_dup_keys"))
    return _union(frames)


def dup_natural_keys(t) -> DataFrame:
    """Natural keys that occur more than once: table, key text, rows."""
    return _union([
        duplicates(getattr(t, name), list(key)).select(
            F.lit(name).alias("table_name"),
            F.concat_ws("|", *[c(k).cast("string") for k in key]).alias("key_text"), "n")
        for name, key in schema.NATURAL_KEYS.items()])


# ---- references --------------------------------------------------------

def orphan_keys(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Referenced keys without a parent, and how many child rows have them.

    Child rows are counted per key first, so a key held by many rows moves once.
    """
    used = child.where(c(column).isNotNull()).groupBy(c(column).alias("id")).agg(F.count("*").alias("n"))
    return used.join(parent.select("id"), "id", "left_anti")


def orphans(t) -> DataFrame:
    """Per reference: child rows, missing parent keys, child rows that have them.

    Each child table is read once for all its references, each parent once for
    all that refer to it; keys are counted before they move.
    """
    names = [(f"{child}.{column}", child, column, parent) for child, column, parent in schema.FOREIGN_KEYS]
    used = _union([
        getattr(t, child).select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("reference"), F.lit(parent).alias("parent"), c(column).cast("bigint").alias("id"))
            for name, table, column, parent in names if table == child])))
        for child in dict.fromkeys(n[1] for n in names)
    ]).groupBy("reference", "parent", "id").agg(F.count("*").alias("n"))
    known = _union([
        getattr(t, parent).select(F.lit(parent).alias("parent"), c("id").cast("bigint").alias("id"), F.lit(True).alias("known"))
        for parent in dict.fromkeys(n[3] for n in names)])
    missing = c("known").isNull() & c("id").isNotNull()
    found = used.join(known, ["parent", "id"], "left").groupBy("reference").agg(
        F.sum("n").alias("n_rows"), F.count_if(missing).alias("n_missing_keys"), F.sum(F.when(missing, c("n"))).alias("n_orphan_rows"))
    every = known.sparkSession.createDataFrame([(n[0],) for n in names], "reference string")
    return every.join(found, "reference", "left").na.fill(0)


def blocked_deletes(t, parent: str, keys: DataFrame) -> DataFrame:
    """Which of ``keys(id)`` cannot be deleted from ``parent``, and what still uses them."""
    frames = []
    for child, column, table in schema.FOREIGN_KEYS:
        if table != parent or (child, column, table) == schema.CASCADING:
            continue
        used = getattr(t, child).groupBy(c(column).alias("id")).agg(F.count("*").alias("n_rows"))
        frames.append(used.join(keys.select("id"), "id", "left_semi").select(
            "id", F.lit(f"{child}.{column}").alias("used_by"), "n_rows"))
    return _union(frames)


def cascade_costs(costs: DataFrame, purchases: DataFrame) -> DataFrame:
    """Cost rows left once the costs of deleted purchases are gone with them."""
    return costs.join(purchases.select(c("id").alias("grass_id")), "grass_id", "left_semi").select(*costs.columns)


# ---- values ------------------------------------------------------------

def bad_values(t) -> DataFrame:
    """Per table and column: rows, forbidden nulls, texts beyond their length.

    One pass and one small row per table.
    """
    frames = []
    for name in schema.DDL:
        checks = []
        for f in schema.declared(name):
            text = isinstance(f.dataType, T.VarcharType)
            nulls = F.count_if(c(f.name).isNull()) if not f.nullable else F.lit(0).cast("bigint")
            long = F.count_if(F.length(f.name) > f.dataType.length) if text else F.lit(0).cast("bigint")
            if text or not f.nullable:
                checks.append((f.name, nulls, long))
        wide = getattr(t, name).agg(F.count("*").alias("n_rows"), *[
            F.struct(F.lit(col).alias("column_name"), nulls.alias("n_null"), long.alias("n_too_long")).alias(f"_{i}")
            for i, (col, nulls, long) in enumerate(checks)])
        frames.append(wide.select(
            F.lit(name).alias("table_name"), "n_rows", F.inline(F.array(*[c(f"_{i}") for i in range(len(checks))]))))
    return _union(frames)


def customer_types(customers: DataFrame) -> DataFrame:
    """Customer kinds in use, and whether each is one of the declared ones."""
    return customers.groupBy("customer_type").agg(F.count("*").alias("n_rows")).withColumn(
        "valid", F.coalesce(c("customer_type").isin(*schema.CUSTOMER_TYPES), F.lit(False)))


def bad_customer_type(customers: DataFrame) -> DataFrame:
    return customers.where(~F.coalesce(c("customer_type").isin(*schema.CUSTOMER_TYPES), F.lit(False)))


# ---- stored totals -----------------------------------------------------

def drift(stored: DataFrame, column: str, recomputed: DataFrame) -> DataFrame:
    """Stored against recomputed values of ``column`` by ``id``; one that is missing on either side is null, and so is the difference."""
    fresh = recomputed.select("id", c(column).cast(TOTAL).alias("recomputed"))
    return stored.select("id", c(column).cast(TOTAL).alias("stored")).join(fresh, "id", "full").withColumn(
        "difference", (c("stored") - c("recomputed")).cast(TOTAL))
