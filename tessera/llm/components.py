"""Connected components by alternating large-star and small-star steps.

Both steps only relabel edges towards smaller node numbers and keep connectivity
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), so they
need a logarithmic number of rounds.  A node's edges are never gathered: its
smallest neighbour comes from an aggregate with partial sums, and a join deals
the result.  A hub's edges are not shuffled for that join: the few nodes that can
hold a stated share of all edges are broadcast instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import persist

#: A node with more than one in so many of the edges is a hub.  Degrees add up to twice the edges, so there are never more than twice as many hubs, however large the graph.
HUB_SHARE = 1000


def _least(edges: DataFrame) -> DataFrame:
    """u, m, n: the smallest of each node and its neighbours, and its number of edges."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("v").alias("n"))


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """u, v, m: the edges u, v (at most ``n_edges``) with m of ``least`` (u, m, n)."""
    hubs = least.where(F.col("n") * HUB_SHARE > n_edges).select("u", F.col("m").alias("_m"))
    known = edges.join(F.broadcast(hubs), "u", "left")
    rest = known.where("_m IS NULL").select("u", "v").join(least.select("u", "m"), "u")
    return known.where("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).union(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges a, b.

    Loops and repeated edges do no harm; an edge with a null end is ignored; no
    edges give no rows.
    """
    now = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        n_edges = now.count()  # from the files' footers
        # large star: every larger neighbour v of u goes to the least of u's neighbourhood
        low = _least(now)
        up = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        mid = _with_least(up, low, n_edges).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of u, and u, go to the least of them
        least = mid.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("b").alias("n"))
        down = _with_least(mid.select(F.col("a").alias("u"), F.col("b").alias("v")), least, n_edges).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        after = persist(down.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        # stars only: no node is both a centre and a leaf, and each leaf has one centre
        centres = after.select(F.col("b").alias("a")).distinct()
        done = after.join(centres, "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty()
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
