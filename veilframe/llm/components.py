"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), any type that can be ordered; the root is its component's smallest node.

    Alternating large-star and small-star rounds: a node hands the smallest of its neighbours to its larger neighbours,
    then to its smaller ones, until every component is a star around its root. Each round works on at most as many
    edges as there are and is staged in the shared folder.
    """
    now = stage(_ordered(edges.select("a", "b")), "edges")
    mark = _sum(now)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _ordered(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b"))
        # From here a is the smaller end; a node's smaller neighbours are the a of its b.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        now = stage(_ordered(small.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        if (new := _sum(now)) == mark:
            break
        mark = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sum(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
