"""Connected components by alternating large-star and small-star steps.

Both steps (Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, 2014) are group-by-minimum and
join, so a node with very many neighbours is combined in each task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """edges (a, b: long) -> (node, root): root is the smallest node of node's component."""
    edges = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    mark, step = _mark(edges), 0
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        edges = work.save(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), f"{name}{step}")
        previous, mark = mark, _mark(edges)
        if mark == previous:
            break
    # At the end each node but a root has one edge, to its root.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
