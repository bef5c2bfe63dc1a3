"""Connected components of links that lie in a table, by alternating stars; nothing of a table's size meets at the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_stored, stored, with_group_value


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    lows = with_group_value(_both(edges), ["a"], F.min("b"), "_low", "b")
    return lows.where("b > a").select(F.col("b").alias("a"), F.least("a", "_low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    lows = with_group_value(down, ["a"], F.min("b"), "_low", "b")
    return lows.select(F.col("b").alias("a"), F.col("_low").alias("b")).union(lows.select("a", F.col("_low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root: the smallest node that can be reached, for every node that has a link (columns a and b).

    Each round is written to the shared folder. Hot nodes are salted, see with_group_value. The edges become stars
    around the roots in a number of rounds that grows with the logarithm of the longest chain."""
    edges, seen = stored(edges.select("a", "b").where("a <> b").distinct(), "cc"), None
    for _ in range(most_rounds):
        after = stored(_small_star(_large_star(edges)), "cc")
        drop_stored(edges)
        edges = after
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(check) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = tuple(check)
    raise RuntimeError("the components did not settle")
