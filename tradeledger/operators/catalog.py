"""Listing pages, key-set lookups and parent/child lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAGE = 20           # rows of a page unless asked otherwise
LIST_SPAN = 1_000   # child ids that one nested list covers


def page(table: DataFrame, by: str, skip: int = 0, take: int = PAGE, unique: str = "id") -> DataFrame:
    """Rows ``skip`` to ``skip + take`` in order; ``unique`` settles ties.

    Runs as a top-k: each task keeps ``skip + take`` rows.
    """
    return table.orderBy(by, unique).offset(skip).limit(take)


def by_keys(table: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` is in the one-column ``keys``."""
    return table.join(keys.toDF(column).distinct(), column, "left_semi").select(*table.columns)


def with_children(parents: DataFrame, children: DataFrame, parent: str, name: str,
                  span: int = LIST_SPAN) -> DataFrame:
    """Parents with their children as nested lists, parents without children included.

    A parent has one row per ``part``, a range of ``span`` child ids that has
    children (``part`` 0 without any), whatever its size; so no row and no task
    gathers a whole large parent.  Lists are sorted by id.
    """
    fields = ["id", *[n for n in children.columns if n not in ("id", parent)]]
    lists = children.groupBy(F.col(parent).alias("_parent"), F.expr(f"id div {span}L").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias(name)).withColumnRenamed("_parent", "id")
    return parents.join(lists, "id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))


def category_products(categories: DataFrame, products: DataFrame) -> DataFrame:
    return with_children(categories, products, "category_id", "products")


def product_units(products: DataFrame, units: DataFrame) -> DataFrame:
    return with_children(products, units, "product_id", "units")
