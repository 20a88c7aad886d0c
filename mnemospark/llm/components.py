"""Connected components of links between integer nodes, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b); root is the smallest node it reaches.

    Large-star and small-star steps (pointing every neighbour at the smallest one) until the
    links no longer change; a few rounds of the logarithm of the longest chain. Each round is
    stored in the shared folder. No neighbourhood is gathered: minima are aggregated and joined
    back. An empty table gives an empty table.
    """
    now = common.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        # Large star: the larger neighbours of a node go to the smallest of it and its neighbours.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: the smaller neighbours and the node itself go to the smallest neighbour.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("x"))
        after = common.stored(small.select(F.col("x.lo").alias("hi"), F.col("x.m").alias("lo")).filter("hi <> lo").distinct(), "links")
        signature = [F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))]
        if now.agg(*signature).first() == after.agg(*signature).first():
            break
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
