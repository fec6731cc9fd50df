"""Connected components of a graph, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import pin

#: Nodes of a graph that may be hubs.
HUBS = 1000


def repeated_ids(members: DataFrame) -> DataFrame:
    """Links (a, b) that make rows of one id one node, where an id belongs to several classes.

    ``members``: node, the row's own id, and id, that of its class.
    """
    several = members.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("node")
    return members.join(several.hint("merge"), "node").select(F.col("node").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, component), the smallest node of each.

    ``edges``: columns a, b. Alternating large-star and small-star rounds until the graph is
    stars around the smallest nodes. Each is an aggregation, combined on the map side, and a join
    on the node in which a hub's links stay where they are (``_with_low``). Every round is
    pinned; only a count reaches the driver.
    """
    ordered = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = pin(edges.select(ordered.alias("e")).select("e.*").where("a <> b").distinct(), "edges")
    while not _are_stars(now):
        n = now.count()
        both = now.union(now.select("b", "a"))
        large = _with_low(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        small = _with_low(large, n).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = pin(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _with_low(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` links (a, b) with m, the smallest b of their a.

    At most ``HUBS`` nodes can have more than a ``HUBS``-th of all links, so their minima are broadcast
    whatever the graph looks like; the links of all others are joined by node, and no node
    brings more than such a share to one task.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hub = F.broadcast(low.where(F.col("n") > n // HUBS).select("a", "m"))
    rest = edges.join(hub.select("a"), "a", "left_anti").join(low.where(F.col("n") <= n // HUBS).select("a", "m"), "a")
    return edges.join(hub, "a").union(rest)


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one parent at most, and no parent a parent? Edges (a, b) with b < a, distinct."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
