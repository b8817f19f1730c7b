"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that has a link (a, b).

    Each round hangs a node's larger neighbours, then its smaller ones, under the
    smallest neighbour, until all components are stars. Only minima per node are
    aggregated, before the shuffle, so a node with very many links costs no task
    more than a row for each of them.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("b", F.lit(0), F.lit(1))
        )
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():  # every node hangs under one that hangs under none
            roots = edges.select("b", "b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = kept(small.where("a <> b").distinct())
