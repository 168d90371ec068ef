"""Tidying: similar pictures, rules for which copy to keep, and the journal of what was removed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources.store import drop, kept

#: Hashes that meet in one task, on each side.
BLOCK = 4_096
NEAR_BITS = 16
# Folders that systems keep passing files in, and the marks that systems put on copies' names.
SPARE_FOLDERS = (
    "$recycle.bin", ".cache", ".thumbnails", ".trash", ".trash-1000", "autosave", "backup", "backups", "cache", "downloads", "lost+found", "old files",
    "recycle bin", "recycler", "temp", "temporary internet files", "tmp", "trash",
)
WINDOWS_COPY = r" - copy(?: \([0-9]+\))?$"
MAC_COPY = r" copy(?: [0-9]+)?$"
LINUX_COPY = r" \((?:copy|another copy|[0-9]+(?:st|nd|rd|th) copy)\)$"
BROWSER_COPY = r" ?\([0-9]+\)$"
COPY_NAME = f"(?i)^copy of |{WINDOWS_COPY}|{MAC_COPY}|{LINUX_COPY}|{BROWSER_COPY}"


def near_hashes(rows: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """(a, b, bits), a < b: 64-bit hashes of one group that differ in at most `most` bits.

    rows: (grp, id, h). A group is dealt to blocks; a task holds two of them and returns near pairs only.
    """
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = rows.join(sizes, "grp").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    copies = dealt.select("grp", "id", "h", "k", others).select("grp", F.least("k", "o").alias("r"), F.greatest("k", "o").alias("c"), "k", "id", "h")

    def pairs(block: pd.DataFrame) -> pd.DataFrame:
        r, c = int(block["r"].iloc[0]), int(block["c"].iloc[0])
        left, right = block[block["k"] == r], block[block["k"] == c]
        x, y = (side["h"].to_numpy(np.int64).view(np.uint64) for side in (left, right))
        a, b = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        found = []
        for i in range(len(x)):
            bits = np.bitwise_count(y ^ x[i])
            hit = np.flatnonzero((bits <= most) & ((b > a[i]) if r == c else (b != a[i])))
            found.append(pd.DataFrame({"a": np.minimum(a[i], b[hit]), "b": np.maximum(a[i], b[hit]), "bits": bits[hit].astype(np.int32)}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "bits": []}).astype({"a": "int64", "b": "int64", "bits": "int32"})

    return copies.groupBy("grp", "r", "c").applyInPandas(pairs, "a long, b long, bits int")


def reused(photos: DataFrame, most: int, within: int) -> DataFrame:
    """(id, other, bits): for each picture the one of its group that is most like it, of equals the nearest in time, then
    the least id; hashes differ in at most `most` bits and times by at most `within`. A picture with none has no row.

    photos: (grp, id, h, at). Equal hashes are one class and only classes are paired; of a class, pictures of one
    time are one cell, and a lone picture looks at the cell before it and the one after it in each class that is near,
    so that what is shuffled grows with pictures and not with their pairs. Rows without a hash or a time take no part.
    """
    own = Window.partitionBy("grp", "h", "at").orderBy("id")
    placed = photos.filter("h is not null and at is not null").select("grp", "h", "at", "id", F.first("id").over(own).alias("first"), F.lead("id").over(own).alias("next"))
    other = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("next"))
    placed = kept(placed.select("grp", "h", "at", "id", (F.col("id") == F.col("first")).alias("leads"), other.alias("other")), "placed")
    at_once = placed.filter("other is not null").select("id", F.struct(F.lit(0).alias("bits"), F.lit(0).cast("long").alias("gap"), "other").alias("m"))
    cell = F.struct("at", F.col("id").alias("other"))
    beside = Window.partitionBy("grp", "h").orderBy("at")
    cells = placed.filter("leads").select("grp", "h", "at", "id", F.col("other").isNull().alias("alone"))
    same = cells.select("id", "at", "alone", F.lit(0).alias("bits"), F.array(F.lag(cell).over(beside), F.lead(cell).over(beside)).alias("near")).filter("alone")
    classes = kept(cells.groupBy("grp", "h").agg(F.min("id").alias("id")), "classes")
    side = lambda i, h: classes.select("grp", F.col("id").alias(i), F.col("h").alias(h))
    pairs = near_hashes(classes, most).join(side("a", "x"), "a").join(side("b", "y").drop("grp"), "b")
    pairs = kept(pairs.select("grp", F.explode(F.array(F.struct(F.col("x").alias("h"), F.col("y").alias("to")), F.struct(F.col("y").alias("h"), F.col("x").alias("to")))).alias("p"), "bits").select("grp", "p.*", "bits"), "classpairs")
    asked = cells.filter("alone").join(pairs, ["grp", "h"]).select("grp", "h", "to", "bits", "at", "id", F.lit(None).cast("struct<at:bigint,other:bigint>").alias("cell"))
    offered = cells.select("grp", F.col("h").alias("to"), "at", cell.alias("cell")).join(pairs, ["grp", "to"])
    offered = offered.select("grp", "h", "to", "bits", "at", F.lit(None).cast("long").alias("id"), "cell")
    of_pair = Window.partitionBy("grp", "h", "to")
    last = lambda *by: F.last("cell", ignorenulls=True).over(of_pair.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = asked.unionByName(offered).select("id", "at", "bits", F.array(last(F.asc("at"), F.col("id").asc_nulls_first()), last(F.desc("at"), F.col("id").asc_nulls_first())).alias("near")).filter("id is not null")
    found = same.drop("alone").unionByName(met).select("id", "at", "bits", F.explode("near").alias("n")).filter("n is not null")
    gap = F.abs(F.col("at") - F.col("n.at"))
    found = found.filter(gap <= within).select("id", F.struct("bits", gap.alias("gap"), F.col("n.other").alias("other")).alias("m"))
    best = at_once.unionByName(found).groupBy("id").agg(F.min("m").alias("m"))
    return best.select("id", F.col("m.other").alias("other"), F.col("m.bits").alias("bits"))


def greedy_clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster): in order of id, a row joins the first earlier representative that it is near to, or is one.

    rows: (id); pairs: (a, b) with a < b. A row is settled once all its earlier neighbours are: it is a
    representative if none of them is. Rounds settle many rows at once; a count of what is open ends them.
    """
    near = kept(pairs.select("a", "b").distinct(), "pairs")
    state = kept(rows.select("id", F.lit(None).cast("boolean").alias("rep")), "state")
    while True:
        earlier = near.join(state.select(F.col("id").alias("a"), F.col("rep").alias("a_rep")), "a")
        seen = earlier.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("a_rep", F.lit(False))).alias("joins"), F.bool_or(F.col("a_rep").isNull()).alias("waits"))
        settled = F.when(F.col("rep").isNotNull(), F.col("rep")).when(F.coalesce("joins", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        before, state = state, kept(state.join(seen, "id", "left").select("id", settled.alias("rep")), "state")
        drop(before)
        if state.filter("rep is null").isEmpty():
            break
    reps = state.filter("rep").select(F.col("id").alias("a"))
    first = near.join(reps, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("cluster"))
    return state.join(first, "id", "left").select("id", F.when(F.col("rep"), F.col("id")).otherwise(F.col("cluster")).alias("cluster"))


def in_spare_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(path, "[^/]*$", "")), "/"), F.lit(list(SPARE_FOLDERS)))


def named_like_a_copy(path: Column) -> Column:
    return F.regexp_replace(T.basename(path), r"\.[^.]*$", "").rlike(COPY_NAME)


def keepers(files: DataFrame, group: str, rule: str = "default") -> DataFrame:
    """(group, keep_id): which file of each group a rule keeps."""
    path = F.col("path")
    order = {
        "oldest": F.struct("mtime_ns", "path"),
        "newest": F.struct(-F.col("mtime_ns"), "path"),
        "default": F.struct(in_spare_folder(path), named_like_a_copy(path), "mtime_ns", F.length(T.basename(path)), "path"),
    }[rule]
    return files.groupBy(group).agg(F.min_by("id", order).alias("keep_id"), F.count("*").alias("n")).filter("n > 1").drop("n")


def gone(journal: DataFrame) -> DataFrame:
    """Files whose last entry (id, at, action) of the journal is a removal."""
    return journal.groupBy("id").agg(F.max_by("action", "at").alias("action"), F.max("at").alias("at")).filter("action = 'remove'").select("id", "at")
