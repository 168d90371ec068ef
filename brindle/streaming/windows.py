"""Event-time windows over the change stream. The same functions serve batch and streaming frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int = 4) -> DataFrame:
    """The files of a folder as they come. A path that is one file is that file in its folder, as a stream reads folders."""
    reader, at = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once), spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ts as a UTC timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str) -> DataFrame:
    out = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def bursts(events: DataFrame, quiet_ms: int = 2_000, most_ms: int = 15_000) -> DataFrame:
    """Debounced changes of a stream of (path, ts): state holds a path's open burst and a timer ends it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            first, last, n = state.get
            out.append((key[0], first, last, n))
            state.remove()
        else:
            times = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
            first, last, n = state.get if state.exists else (times[0], times[0], 0)
            for t in times:
                if n and (t - last >= quiet_ms or t - first >= most_ms):
                    out.append((key[0], first, last, n))
                    first, n = t, 0
                last, n = max(last, t), n + 1
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "first_ms", "last_ms", "n"])

    return events.groupBy("path").applyInPandasWithState(
        step, "path string, first_ms long, last_ms long, n long", "first long, last long, n long", "append", "EventTimeTimeout"
    )
