"""Connected components by alternating star steps, in rounds of grouping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of edges (a long, b long).

    Each round sends every node's larger neighbours, then its smaller ones, to the smallest node around it (large star,
    small star); both keep components and shorten paths, and in the end every edge leads to the component's smallest
    node. Smallest neighbours come from a grouped minimum, so a node with very many neighbours is no group in one task.
    """
    links = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        new = kept(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if not new.exceptAll(links).take(1) and not links.exceptAll(new).take(1):
            break
        links = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
