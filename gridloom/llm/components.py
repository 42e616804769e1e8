"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) of every node in the edges ``a, b``; large-star and small-star steps until nothing changes."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tidy=False)
    sign = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lead = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lead, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lead.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, tidy=False)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == sign or not now[0]:
            break
        sign = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
