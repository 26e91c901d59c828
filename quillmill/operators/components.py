"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.skew import hot_join
from quillmill.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns ``node, component``: the smallest node of the component of every node that has an edge.

    Edges with a null end and self-loops link nothing. Each round replaces the edges by the star edges of
    both steps, which are min-aggregations (combined before the shuffle) and one join per step; neighbour
    lists are never gathered. Rounds end when the edge set no longer changes; the number of rounds grows
    with the logarithm of the longest path. Lineage is cut by a reliable checkpoint each round.
    """
    e = edges.select(F.col(a).alias("_x"), F.col(b).alias("_y")).filter("_x != _y")
    e = cut_lineage(e.select(F.greatest("_x", "_y").alias("a"), F.least("_x", "_y").alias("b")).distinct())
    seen = _signature(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = hot_join(both, low, "a", total=2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hot_join(large, low, "a", total=seen[0])
        e = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut_lineage(e.distinct())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))
