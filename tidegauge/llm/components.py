"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them.

    The large star moves the neighbours above the node, the small star those below it and
    the node itself. The smallest neighbour comes from a partial aggregate and is joined
    back, so a node with many neighbours is not gathered anywhere.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        moved = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, root)`` for every node of the edges ``(a, b)`` but the roots themselves.

    Alternates the two stars until the edges stay the same; the number of rounds grows with
    the logarithm of the longest path. Each round is written to the shared folder.
    """
    now = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
    before = mark(now)
    while before[0]:
        now = settle(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select("a", F.col("b").alias("root"))
