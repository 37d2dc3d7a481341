"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins over the edges; the edges of a round are
written to the shared folder, so nothing is held on the driver and a lost executor costs one
round at most.  A hub that holds a large share of all edges is combined map-side in the
minima, and the joins are plain equi-joins whose skewed side AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import stored


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star round on directed pairs (u, v): neighbours are re-linked to their minimum."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))
    if small:
        # v < u for every pair here, so the minimum is always a neighbour of u
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` are undirected pairs of longs; loops, repeats and both directions may occur,
    pairs with a null are ignored.  An empty table gives an empty result.
    """
    cur = stored(edges.where(F.col(a) != F.col(b))  # also drops pairs with a null
                 .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(cur)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        cur = stored(_star(_star(both, small=False).select("u", "v"), small=True), "edges")
        now = _mark(cur)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
