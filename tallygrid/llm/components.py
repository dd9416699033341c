"""Connected components by alternating star contraction: every round is a few joins and map-side minima, whatever the shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _stars(pairs: DataFrame) -> DataFrame:
    """Every node with the least of its neighbours and itself."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node it can reach) of all nodes in ``links`` (columns ``a``, ``b``)."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours of a node hang on the least node around it, then so do smaller ones.
        large = both.join(_stars(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.filter("u <> v").distinct()
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        turned = small.join(least, "u")
        edges = checkpointed(turned.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum("v"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
