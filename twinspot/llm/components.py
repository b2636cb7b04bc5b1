"""Connected components by alternating large-star and small-star.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round at
most. A large-star links every larger neighbour of a node to the node's smallest neighbour, a small-star links the
smaller ones and the node itself; both keep components as they are, and they end in stars around each component's
smallest node. A hub's neighbours are never gathered: the smallest neighbour comes from an aggregate with partial
sums in every task, and the join that brings it back to the edges is one that Spark splits where it is skewed.
Few edges, of known number, are kept in one partition, without shuffles. No edges give no rows; an edge of a node to itself is dropped, and repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, together, written


def _sent(least: DataFrame, rows: int | None) -> DataFrame:
    """Few rows go to the edges, not both to partitions of a key."""
    return F.broadcast(least) if rows is not None and rows <= FILE_ROWS else least


def _large(edges: DataFrame, rows: int | None) -> DataFrame:
    both = together(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), rows)
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(_sent(least, rows), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, rows: int | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return together(down.join(_sent(least, rows), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least), rows)


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root for each node with an edge; ``edges`` has two columns of one ordered type, and ``rows`` rows at most, if that is known."""
    a, b = edges.columns
    now = _clean(together(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), rows))
    while True:
        # a star's edges stay as many, and each of their nodes may get one
        now = together(written(_clean(_small(_large(now, rows), rows)), "edges", None if rows is None else 3 * rows), rows)
        # stars: each node has one edge down, and none leads to a node that has one itself
        ends = together(now.select("a", F.lit(1).alias("down")).union(now.select(F.col("b"), F.lit(0)).distinct()), rows)
        if ends.groupBy("a").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 or down = 1 and n > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
