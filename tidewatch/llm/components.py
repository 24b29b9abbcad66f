"""Connected components of an edge table by alternating large and small stars, all in shuffled joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u, v, least: with the least of u and its neighbours. A node with very many edges is summed before it is shuffled, and its join may be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return edges.join(least, "u")


#: Edges of one file of a round's table.
FILE_ROWS = 1 << 16


def _filed(stars: DataFrame, rows: int) -> DataFrame:
    """stars in as many files as rows edges need, and one for each core at least: the graph shrinks by rounds, and a file
    for each shuffle partition would be thousands of tiny ones. Never more files than there are partitions."""
    return stars.coalesce(max(stars.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the least node reachable) of all nodes of edges (a, b); edges to itself and repeated ones do no harm."""
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen, rows = None, stars.count()
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        # each node's lesser neighbours, and the node itself, go to the least of them
        near = _least_neighbour(large)
        small = near.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(near.select("u", F.col("least").alias("v")))
        stars = written(_filed(small.filter("u <> v").distinct(), rows), "stars")
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, rows = state, state[0]
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
