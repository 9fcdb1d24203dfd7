"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node it reaches.

    Alternates large stars (neighbours above a node go to its least neighbour) and small stars (those below it
    do), which ends after about log2 of the longest chain rounds. Each round is a written table. A node's
    neighbours are never gathered: its least one comes from a combined aggregation and is joined back, so hubs
    cost no more than their links. Links from a node to itself and repeated links are ignored; no links, no rows.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
