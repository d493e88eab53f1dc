"""Connected components of an edge table, by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest neighbour (large
star) and then its smaller neighbours and itself on their smallest (small star).
Both steps are a grouped minimum joined back on the node, so no group is gathered
into one task.  Nodes with more than a thousandth of the edges (hence under two thousand
nodes) are joined by broadcast, so their edges stay spread.  Each round removes
repeats and ends in a checkpoint; the loop stops when the edges no longer
change, which takes O(log n) rounds.  Nothing is collected but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators.durable import durable


#: A node with over one in so many edges is joined by broadcast.
HOT_SHARE = 1000
#: Edges of a node that are never too many for one task.
FEW = 100


def _least(pairs: DataFrame, limit: int | None) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and its neighbours.

    ``limit`` is given where some node has more edges: those nodes go by broadcast."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    if limit is None:
        return pairs.join(least.select("u", "m"), "u")
    hot = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = pairs.join(hot, "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return pairs.join(hot, "u").unionByName(rest)


def _hang(pairs: DataFrame, include_self: bool, limit: int | None) -> DataFrame:
    """pairs (u, v): give every v the smallest of u's neighbours and u."""
    row = lambda end: F.struct(F.col(end).alias("u"), F.col("m").alias("v"))
    ends = F.array(row("v"), row("u")) if include_self else F.array(row("v"))
    hung = _least(pairs, limit).select(F.explode(ends).alias("e")).select("e.u", "e.v")
    return hung.where("u <> v").distinct()


def _large_star(edges: DataFrame, limit: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _least(both, limit).where("v > u")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, limit: int | None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _hang(down, include_self=True, limit=limit)


def _summary(edges: DataFrame):
    """Edges, a hash of them all, and the most edges of one node, on either side."""
    ends = [edges.groupBy(F.col(c).alias("x")).agg(F.count("*").alias("n")).agg(F.max("n").alias(c)) for c in "uv"]
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    return edges.agg(F.count("*").alias("n"), hashed).crossJoin(ends[0]).crossJoin(ends[1]).first()  # single rows


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of a comparable type -> (node, root), root the smallest of its component.

    Only nodes that are not their own root are listed; an edge from a node to
    itself says nothing, and null ends are dropped.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct())
    state = _summary(now)
    while True:
        few = max(FEW, state["n"] // HOT_SHARE)
        limit = few if state["n"] and max(state["u"], state["v"]) > few else None
        now = durable(_small_star(_large_star(now, limit), limit))
        seen = _summary(now)
        if seen["n"] == 0 or tuple(seen) == tuple(state):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
