"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    `edges` has columns a and b in any order, repeats allowed. Large-star and small-star steps alternate
    until every node hangs on its component's smallest one: about log(n) rounds of shuffles of edges, each
    written to the checkpoint folder. Nothing but a count and a checksum reaches the driver.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(edges)
    while mark[0]:
        near = _both(edges)
        least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = near.join(least, "v").where("u > v and u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        edges, before = cut(small), mark
        mark = _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
