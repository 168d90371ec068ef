"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node with a link to another; component is the least node reachable.

    links: two columns of longs. Rounds are written tables; only a count and a checksum of the
    links reach the driver. Minima are aggregated before they are joined, and hot nodes only make
    the links' side of that join skewed, which adaptive execution splits.
    """
    a, b = links.columns
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.save(pairs, "links")
    before = _checksum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array("u", "v"))
        small = large.join(least, "u").select(ends.alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        new = scratch.save(small, "links")
        after = _checksum(new)
        scratch.drop(edges, large)
        edges = new
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]
