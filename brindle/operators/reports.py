"""Counting, duplicates, space and timeline reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T


def newest(files: DataFrame, n: int) -> DataFrame:
    when = F.coalesce("taken_at_ns", "mtime_ns").alias("when_ns")
    return files.select("id", "path", when).orderBy(F.desc("when_ns"), "id").limit(n)


def value_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def status_funnel(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Files in each state; a volume that is away outweighs what the file itself says."""
    state = (
        F.when(F.col("state").isin("OFFLINE", "ARCHIVED"), "Offline").when(F.col("status") == "INDEXED", "Indexed")
        .when(F.col("status") == "PENDING", "Queued").when(F.col("status") == "NAME_ONLY", "Name only")
        .when(F.col("skip_code") == "TIMEOUT", "Timed out").when(F.col("status") == "SKIPPED", "Skipped").otherwise("Failed")
    )
    at = volumes.select(F.col("id").alias("volume_id"), "state")
    return files.join(at, "volume_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Contents that several files have; blank and missing hashes match nothing."""
    known = files.filter("content_hash is not null and content_hash != ''")
    groups = known.groupBy("content_hash").agg(F.count("*").alias("copies"), F.max("size_bytes").alias("size_bytes"), F.min("id").alias("first_id"))
    return groups.filter("copies > 1").withColumn("reclaimable", (F.col("copies") - 1) * F.col("size_bytes"))


def _source(volumes: DataFrame) -> tuple[DataFrame, Column]:
    return volumes.select(F.col("id").alias("volume_id"), "name"), F.coalesce("name", F.lit("this machine")).alias("source")


def duplicate_share(files: DataFrame, volumes: DataFrame) -> DataFrame:
    named, source = _source(volumes)
    known = files.filter("content_hash is not null").select("content_hash", "volume_id")
    # Counts a hash and volume first: what is joined has no more rows than contents times volumes.
    held = known.groupBy("content_hash", "volume_id").agg(F.count("*").alias("n"))
    copies = F.sum("n").over(Window.partitionBy("content_hash"))
    return held.withColumn("copies", copies).join(named, "volume_id", "left").groupBy(source).agg(
        F.sum("n").alias("files"), F.sum(F.when(F.col("copies") > 1, F.col("n")).otherwise(0)).alias("duplicated")
    )


def only_copies(files: DataFrame, volumes: DataFrame) -> DataFrame:
    named, source = _source(volumes)
    single = files.filter("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n"), F.max("volume_id").alias("volume_id")).filter("n = 1")
    return single.join(named, "volume_id", "left").groupBy(source).agg(F.count("*").alias("only_copies"))


def keepers(files: DataFrame) -> DataFrame:
    """The file to keep of each content that several have: on this machine, oldest, shortest path."""
    known = files.filter("content_hash is not null and content_hash != ''")
    order = F.struct(F.col("volume_id").isNotNull(), "mtime_ns", F.length("path"), "path")
    kept = known.groupBy("content_hash").agg(F.count("*").alias("n"), F.min_by("id", order).alias("keep_id"))
    return kept.filter("n > 1").select("content_hash", "keep_id")


def timeline(files: DataFrame, messages: DataFrame) -> DataFrame:
    """(when_ns, branch, id): dated pictures, other files and mail as one series."""
    branch = F.when(F.col("taken_at_ns").isNotNull(), 0).otherwise(1)
    own = files.select(F.coalesce("taken_at_ns", "mtime_ns").alias("when_ns"), branch.alias("branch"), "id")
    mail = messages.filter("sent_at is not null").select((F.col("sent_at") * 1_000_000_000).alias("when_ns"), F.lit(2).alias("branch"), F.col("file_id").alias("id"))
    return own.unionByName(mail)


def timeline_page(series: DataFrame, start_ns: int, stop_ns: int, cursor: tuple[int, int, int] | None, n: int) -> DataFrame:
    """n + 1 rows in order after the cursor: the extra one says that there is more."""
    page = series.filter((F.col("when_ns") >= start_ns) & (F.col("when_ns") < stop_ns))
    if cursor:
        when, branch, id_ = cursor
        # The first test alone can prune row groups.
        page = page.filter(F.col("when_ns") >= when).filter(
            (F.col("when_ns") > when) | (F.col("branch") > branch) | ((F.col("branch") == branch) & (F.col("id") > id_))
        )
    return page.orderBy("when_ns", "branch", "id").limit(n + 1)


def month_of(ns: str) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(F.col(ns) / 1000)), "yyyyMM")


def about(files: DataFrame, topics: list[str], bodies: DataFrame) -> DataFrame:
    """Readable files with each topic in the path or the text; bodies: (id, text). Only ids of hits are joined."""
    out = files.filter(F.col("status").isin("INDEXED", "PARTIAL", "NAME_ONLY"))
    for t in topics:
        hits = bodies.filter(F.lower("text").contains(t.lower())).select("id", F.lit(True).alias("hit")).distinct()
        out = out.join(hits, "id", "left").filter(T.contains_ci(F.col("path"), t) | F.col("hit")).drop("hit")
    return out


def scan(files: DataFrame) -> DataFrame:
    """Counts and bytes a type, with how such files are read."""
    tier = (
        F.when(F.col("ext").isin("pdf", "docx", "xlsx", "eml"), "extractor").when(F.col("ext").isin("txt", "md", "py"), "text")
        .when(F.col("ext") == "jpg", "ocr").otherwise("none")
    )
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).withColumn("tier", tier)


# What downloads, editors and installers leave behind.
LEFTOVER_ENDS = ("tmp", "temp", "part", "partial", "crdownload", "download")
INSTALLER_ENDS = ("msi", "exe", "dmg", "pkg", "iso")


def is_leftover(path: Column) -> Column:
    """Partial downloads, temporary and owner files, and installers in a downloads folder."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    folders = F.split(F.lower(F.regexp_replace(path, "[^/]*$", "")), "/")
    return ext.isin(*LEFTOVER_ENDS) | T.basename(path).startswith("~$") | (ext.isin(*INSTALLER_ENDS) & F.array_contains(folders, "downloads"))


def case_twins(files: DataFrame) -> DataFrame:
    """Files whose paths differ in case only."""
    key = F.lower("path")
    several = files.groupBy(key.alias("key")).agg(F.count_distinct("path").alias("n")).filter("n > 1").select("key")
    return files.withColumn("key", key).join(several, "key", "left_semi").drop("key")
