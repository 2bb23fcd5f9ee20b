"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges with a > b."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # a plain table, so that a hot node's join is split
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    floor = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(floor).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges``
    (a, b) that isn't itself the smallest of its component.

    The rounds go on until every edge leads to a node that has none of its own,
    so their number follows the logarithm of the longest chain.  Each round is a
    table in the shared folder; hot nodes are summed up before their rows join.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    while not _settled(stars):
        stars = written(_stars(stars), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none to a smaller one."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
