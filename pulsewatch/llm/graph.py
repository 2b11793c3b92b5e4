"""Connected components of a link table, by alternating star contraction.

Each round is a few shuffles of the links; a node with very many links is one
large join key, which adaptive execution splits.  Nothing is collected but one
count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _to_smallest(pairs: DataFrame, keep_node: bool) -> DataFrame:
    """Links from the neighbours of each u to the smallest node of its star."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    met = pairs.join(low, "u")
    if keep_node:  # v < u: the neighbours and u itself
        star = met.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return star.unionByName(low.select("u", F.col("low").alias("v"))).distinct()
    return met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _checksum(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; root: smallest node reachable."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = saved(e)
    seen = _checksum(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, keep_node=False)
        e = saved(_to_smallest(large, keep_node=True))
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
