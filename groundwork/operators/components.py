"""Connected components by alternating star contraction.

Each round rewires every edge towards the smallest node of its neighbourhood, in
two steps (larger neighbours, then smaller ones), until each component is a star
around its smallest node; the number of rounds grows with the logarithm of the
size.  A round is two aggregations with map-side combine and two joins, whose hot
keys Spark can split, and is written out, so lineage stays short.  Whether all are
stars is seen from one aggregation over the nodes.  Only a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.plans.scratch import stored


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each larger node u of pairs(u, v) is in one pair only and no v is a u."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("larger")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("larger")))
    return ends.groupBy("node").agg(F.sum("larger").alias("n"), F.count("*").alias("c")).where("n > 0 and c > 1").count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges -> (node, component), the component being its smallest node.  Self-loops and nulls are ignored."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = stored(pairs)
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
