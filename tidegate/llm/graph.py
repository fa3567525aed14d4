"""Connected components of links, by alternating star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint, drop_finished


def components(links: DataFrame) -> DataFrame:
    """`links` (a long, b long) -> one row (node, component) for each node that has a link.

    `component` is the smallest node reachable. Each round hangs the larger neighbours of a node below
    its smallest one (large star), then the smaller ones (small star); rounds grow with the logarithm of
    a chain's length. A hub's rows are met by a join that Spark may split, never by a list. Nulls and
    loops are ignored; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = checkpoint(edges), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(below.union(least.select("u", F.col("m").alias("v"))).distinct())
        del both, low, large, least, below
        drop_finished(edges.sparkSession)
