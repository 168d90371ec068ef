"""Change detection, merges and debouncing of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): added, removed, changed (stamp and hash differ), touched (stamp only) or same."""
    o = old.select(F.col(key), F.col("mtime_ns").alias("m0"), F.col("size_bytes").alias("s0"), F.col("content_hash").alias("h0"), F.lit(True).alias("was"))
    n = new.select(F.col(key), F.col("mtime_ns").alias("m1"), F.col("size_bytes").alias("s1"), F.col("content_hash").alias("h1"), F.lit(True).alias("is"))
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when((F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1")), "same")
        .when(F.col("h0") == F.col("h1"), "touched").otherwise("changed")
    )
    return o.join(n, key, "full").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: list[str]) -> DataFrame:
    """new over old by key; columns in keep_old hold their old value where the new one is null."""
    columns = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("fresh"))
    take = lambda c: F.coalesce(f"n_{c}", f"o_{c}") if c in keep_old else F.when(F.col("fresh"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    return o.join(n, key, "full").select(key, *[take(c).alias(c) for c in columns])


def replace_passages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, old_id, ordinal, action): passages match by text and how often it came before, so kept
    ones keep their id and their vector."""
    nth = F.row_number().over(Window.partitionBy("file_id", "h").orderBy("ordinal"))
    mark = lambda df: df.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("nth", nth)
    o = mark(old).select("file_id", "h", "nth", F.col("id").alias("old_id"), F.col("ordinal").alias("o"))
    n = mark(new).select("file_id", "h", "nth", F.col("ordinal").alias("n"))
    action = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "insert").otherwise("keep")
    return o.join(n, ["file_id", "h", "nth"], "full").select("file_id", "old_id", F.coalesce("n", "o").alias("ordinal"), action.alias("action"))


def moves(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id): files that went and files that came with one size and hash, each used once."""
    nth = F.row_number().over(Window.partitionBy("size_bytes", "content_hash").orderBy("id"))
    side = lambda df, c: df.filter("content_hash is not null").withColumn("nth", nth).select("size_bytes", "content_hash", "nth", F.col("id").alias(c))
    return side(gone, "old_id").join(side(new, "new_id"), ["size_bytes", "content_hash", "nth"]).select("old_id", "new_id")


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, value, outcome) of three versions of key-value units: one changed side wins, two that agree
    are one, two that differ are a conflict in which the remote side stands."""
    named = lambda df, c: df.select(key, F.col("value").alias(c))
    met = named(base, "b").join(named(local, "l"), key, "full").join(named(remote, "r"), key, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = F.when(same("l", "r"), "agreed").when(same("b", "l"), "remote").when(same("b", "r"), "local").otherwise("conflict")
    value = F.when(F.col("outcome") == "local", F.col("l")).otherwise(F.col("r"))
    return met.withColumn("outcome", outcome).select(key, value.alias("value"), "outcome")


def debounced(events: DataFrame, quiet_s: int = 2, most_s: int = 15) -> DataFrame:
    """(path, first, last, n) of bursts: a change joins the burst before it unless there were quiet_s
    seconds between, and a burst is let go when it is most_s seconds old."""
    by_path = Window.partitionBy("path").orderBy("ts", "event_id")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(by_path)
    island = F.sum(F.when(gap < quiet_s, 0).otherwise(1)).over(by_path.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("island", island)
    age = F.col("ts").cast("double") - F.min(F.col("ts").cast("double")).over(Window.partitionBy("path", "island"))
    rows = rows.withColumn("slice", F.floor(age / most_s))
    return rows.groupBy("path", "island", "slice").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("island", "slice")
