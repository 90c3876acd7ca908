"""Connected components by alternating large and small stars.

Every step is a grouped minimum and a join, so a node with most of the edges
is reduced before the shuffle and split in the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.session import materialize_observed


def _smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every pair with ``m``, the smallest of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest
    node of its component."""
    seen = dict(n=F.count(F.lit(1)), mark=F.bit_xor(F.xxhash64("u", "v")))
    links, now = materialize_observed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "components: edges", **seen)
    before = None
    while now != before and now["n"]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(links.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        small = _smallest(large)
        small = small.select("v", "m").where("v <> m").unionByName(small.select(F.col("u").alias("v"), "m")).distinct()
        before = now
        links, now = materialize_observed(small.select(F.col("v").alias("u"), F.col("m").alias("v")),
                                          "components: stars", **seen)
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
