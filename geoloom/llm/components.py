"""Connected components of a link table, by large-star and small-star rounds that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_skewed


def _least(edges: DataFrame) -> DataFrame:
    """u, its degree, and the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("held"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node that can be reached, for each node of `links` (u, v); nodes without links are not in it.

    Each round joins every edge with the least neighbour of one end; nodes of high degree take the broadcast side of
    join_skewed. Rounds end when the star edges stop changing; their number grows with the logarithm of the longest chain.
    """
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        total = edges.count()
        if not total:
            break
        both = durable(_both(edges))
        large = join_skewed(both, durable(_least(both)), "u", "held", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        small = join_skewed(large, durable(_least(large)), "u", "held", total)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle; allow more rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
