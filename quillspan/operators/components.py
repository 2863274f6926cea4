"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import maybe_broadcast, stage, unstage

#: Edges of one node from which it is joined apart from the others.
HOT_DEGREE = 100_000


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Joins each (u, v) with the least neighbour of u; nodes of very many edges are joined by broadcast of their few rows."""
    hot = maybe_broadcast(least.where(F.col("deg") > HOT_DEGREE).select("u", "m"))
    cool = least.where(F.col("deg") <= HOT_DEGREE).select("u", "m")
    return pairs.join(cool, "u").unionByName(pairs.join(hot, "u"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:  # all neighbours; the larger ones are hung on the least
        pairs = edges.unionByName(back)
    else:  # the smaller neighbours and the node itself are hung on the least
        pairs = edges.unionByName(back).where("v < u")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
    hung = _with_least(pairs, least).select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("_own"))
    if large:
        out = hung.where(F.col("u") > F.col("_own")).select("u", "v")
    else:
        out = hung.select("u", "v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an undirected edge list; the component is its least node.

    Both ends must have one orderable type. Null ends are dropped, self links and repeated links change nothing (a node
    with only a self link is a component of its own). Each round is staged, so a lost executor repeats little; the number
    of rounds grows with the logarithm of the longest path.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = stage(given.select("u").unionByName(given.select(F.col("v").alias("u"))).distinct(), "nodes")
    now = stage(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        mid = stage(_star(now, True), "large-star")
        new = stage(_star(mid, False), "small-star")
        unstage(mid)
        unstage(now)
        now = new
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
