"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a long, b long): the least node reachable.  Nodes without edges are absent."""
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, size = None, _signature(now)
    while size[0] and size != before:
        both = now.union(now.select("v", "u"))
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = table(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = table(small.where("u <> v").distinct())
        before, size = size, _signature(now)
    stars = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
