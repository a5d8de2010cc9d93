"""Connected components of a large sparse graph by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): the smallest node that can be reached.

    Alternating stars: every node first hands its larger neighbours to its smallest neighbour, then
    hands its smaller neighbours on to the smallest of them, until the links are stars around
    the roots. The links never grow in number, and rounds are logarithmic in the longest path. A
    round only takes minima per node (summed on the map side) and joins them back (split when one
    node is hot); each round's links are written to the shared folder.
    """
    links = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # large star: both directions; neighbours above u move to the smallest of u and its neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = settle(large)
        # small star: u and its neighbours below u move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y")
        links = settle(moved.unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct().toDF("a", "b"))
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
