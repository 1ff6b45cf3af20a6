"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links ``a > b``. Large: every larger neighbour of a node goes to its smallest; small: the node and every smaller one."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that one has none."""
    ends = links.select("a").distinct()
    seen = links.agg(F.count("a").alias("n"), F.countDistinct("a").alias("nodes")).first()
    return seen.n == seen.nodes and links.select("b").distinct().join(ends, F.col("b") == F.col("a"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a long, b long)``; the root is the smallest node of its component.

    Minima are pre-aggregated, so a hub's links never meet in one group; each round is cut off by a
    checkpoint, and only a few numbers a round reach the driver. Links may repeat, point either way or to themselves.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(links):
        links = cut(_star(_star(links, True), False))
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
