"""Connected components of a link table by alternating large and small stars.

Every step is a join and an aggregation; a node with very many links is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, root) for every node of ``links(a, b)``; root is the smallest node reachable."""
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    was, now = None, _print(edges)
    while now != was:
        after = _small_star(_large_star(edges).distinct()).where("a <> b").distinct()
        after = materialize(after, "links")
        release(edges)
        edges, was, now = after, now, _print(after)
    return edges.select("a", F.col("b").alias("root"))
