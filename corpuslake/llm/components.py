"""Connected components of an edge table, by large and small star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a table of minima that are broadcast (16 bytes each); beyond, both sides of its join are shuffled.
SMALL = 500_000
#: Edges in a partition of a round's result, about.
PART = 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Each round is two pairs of a grouped minimum (combined before the shuffle) and an equi-join, then a
    checkpoint, so neither a node with very many edges nor a lost executor needs special care. Rounds
    grow with the logarithm of the longest shortest path. Null ends and self loops are ignored.
    """
    now = cut(edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        few = F.broadcast if 2 * mark[0] <= SMALL else lambda df: df  # minima have at most two rows an edge
        # Large star: every greater neighbour of a node is hung below the least of its neighbourhood.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(few(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: lesser neighbours, and the node itself, are hung below the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        # A round has no more edges than the one before: few of them stay in few tasks.
        now = cut(small.distinct().coalesce(8 + mark[0] // PART))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    # Stars: each node but the centres is the greater end of one edge.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
