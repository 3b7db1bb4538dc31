"""Connected components of an edge table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge table (a, b): the smallest node that can be reached.

    Large-star and small-star steps alternate until nothing changes; every step is a few grouped minima and joins on nodes, and
    its result is a written table. Loops, repeated edges and edges in both directions are fine; null ends are ignored. A node
    without an edge other than a loop to itself does not appear.
    """
    state = stage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        n, mark = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (n, mark) == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
        before = (n, mark)
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lowest.select("a", F.col("m").alias("b")))
        state = stage(small.distinct(), "edges")
