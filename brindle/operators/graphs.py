"""Connected components and co-occurrence over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.store import drop, kept


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each node of (a, b) reaches.

    Each round links a node's larger neighbours to its least one, then all of its smaller ones to their least, until
    the edges are stars around components' least nodes. Neighbours are never gathered in a group: their minimum is
    aggregated before the shuffle and joined to the edges, whose hot nodes adaptive execution splits.
    """
    ends = F.col("a"), F.col("b")
    alone = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = kept(edges.filter("a != b").select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = kept(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(first, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = kept(moved.union(first).distinct(), "stars")
        drop(now, large)
        was, now, mark = mark, new, _fingerprint(new)
        if mark == was:
            rows = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b"))
            return rows.union(alone).groupBy("node").agg(F.min("component").alias("component"))
    raise RuntimeError("components didn't settle")


def _fingerprint(edges: DataFrame) -> tuple:
    """The count and a sum of hashes of distinct edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def co_occurrence(mentions: DataFrame, least: int = 2) -> DataFrame:
    """(x, y, weight, pmi) of entities that share chunks, from distinct (chunk, entity). A chunk's pairs are made in its row."""
    n = mentions.select("chunk").distinct().agg(F.count("*").alias("n"))
    single = mentions.groupBy("entity").agg(F.count("*").alias("k"))
    sets = mentions.groupBy("chunk").agg(F.sort_array(F.collect_set("entity")).alias("e"))
    starts = sets.select("e", F.posexplode("e").alias("i", "x"))
    pairs = starts.select("x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y")).groupBy("x", "y").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    named = lambda c, k: single.select(F.col("entity").alias(c), F.col("k").alias(k))
    met = pairs.join(named("x", "kx"), "x").join(named("y", "ky"), "y").join(F.broadcast(n))
    return met.select("x", "y", "weight", F.round(F.log2(F.col("n") * F.col("weight") / (F.col("kx") * F.col("ky"))), 6).alias("pmi"))


def running_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns of each conversation whose costs fit the budget together."""
    spent = F.sum("cost").over(Window.partitionBy("conversation").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("spent", spent).filter(F.col("spent") <= budget)
