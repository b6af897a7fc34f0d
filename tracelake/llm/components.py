"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import durable


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and by chance only for different ones."""
    h = F.xxhash64("u", "v").cast("decimal(38)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("v", "u").cast("decimal(38)"))).first())


def hot_limit(rows: int) -> int:
    """Rows of one key from which on a join by it is taken apart: at most 100,000 keys reach it in any table."""
    return max(1_000, rows // 100_000)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) on ``keys``, where some keys have very many rows of ``left``.

    ``hot``: those keys (``hot_limit`` bounds their number). Their rows of ``right`` are broadcast, and their
    rows of ``left`` stay where they are; all others are shuffled.
    """
    hot = hot.select(*keys)
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = durable(hot)
    few = F.broadcast(hot)
    mine = left.join(F.broadcast(right.join(few, keys, "left_semi")), keys, "inner")
    rest = left.join(few, keys, "left_anti").join(right, keys, how)
    # Hot keys that the right side lacks.
    if how == "left":
        lacking = F.broadcast(hot.join(right, keys, "left_anti"))
        mine = mine.unionByName(left.join(lacking, keys, "left_semi"), allowMissingColumns=True)
    return mine.unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root: its component's smallest node.

    Each step groups by node with partial aggregation and joins the minima back; the minima of
    nodes with very many links are broadcast, so those links aren't gathered in one task. The
    steps' number grows with the logarithm of the largest component. Self links are allowed; no
    links: no rows.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = _digest(edges)
    while True:
        many = hot_limit(2 * now[0])
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = durable(least)
        large = hot_join(both.where("v > u"), least.select("u", "m"), ["u"], least.where(F.col("n") > many), "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node whose neighbours are all smaller keeps its link to the least of them.
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small)
        edges, before, now = new, now, _digest(new)
        if before == now:
            break
    found = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(found, nodes.node == found.u, "left").select("node", F.coalesce("root", "node").alias("root"))
