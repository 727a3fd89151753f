"""Connected components of a graph given by its edges, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` that is not its component's root;
    the root is the smallest node.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller
    neighbours.  Minima are aggregates with map-side combine; a node with very many
    neighbours spreads over the tasks of a join that adaptive execution may split.  The
    driver sees two numbers per round.
    """
    def ordered(u, v):
        return F.greatest(u, v).alias("u"), F.least(u, v).alias("v")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = cut_lineage(edges.where("u <> v").select(*ordered("u", "v")).distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
