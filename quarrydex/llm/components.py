"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that has a link to another; ``links`` has columns a and b.

    The root is the smallest node of the component.  Each round is two aggregations with map-side
    combination and two joins; the links after a round are written out, so lineage stays short.  A node
    with very many links is the large side of a join, which adaptive execution splits.
    """
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
