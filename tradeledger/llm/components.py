"""Connected components of a link table, by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, at the
smallest node known.  A round only groups and joins, so no component is ever
gathered in one place, and the link table shrinks to one star per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeledger.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another; ``component`` is the smallest node reachable.

    Null ends and links of a node to itself are no links.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u > v").distinct()
    pairs, before = checkpointed(pairs), None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        before = state
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(small.union(least).distinct())
