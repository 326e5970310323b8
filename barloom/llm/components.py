"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mark(table: DataFrame) -> tuple:
    """Two numbers that change with the rows of (u, v)."""
    return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges (a, b).

    Each round links every node to the smallest of its neighbourhood and hands
    its other neighbours on to it; rounds grow with the logarithm of the longest
    path. Each round's table is a checkpoint, so a lost executor costs one round.
    A hot node's neighbours are only aggregated by min and then joined with it.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = handed.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().checkpoint()
        before, mark = mark, _mark(small)
        if mark == before:
            roots = small.select(F.col("v").alias("node")).distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        now = small
