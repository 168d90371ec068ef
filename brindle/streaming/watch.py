"""Changes of watched files, applied from a stream: writes that a replay leaves as they are, and retries by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds until a locked file is tried again and how often that is done, seconds after an error, doubled each time up to the last.
LOCKED_S, LOCKED_TRIES = 30, 4
ERROR_S, MOST_ERROR_S = 30, 600
RETRIES = "path string, at_ms long, attempt int, what string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BatchTable:
    """A table that a stream writes with foreachBatch: the rows of a batch are a folder named by its id.

    A batch that comes again, after a restart or a failure, overwrites its own folder and no other, so each
    batch counts once. Readers see a batch when its write has been committed.
    """

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder.rstrip("/"), schema

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, batch long").option("basePath", self.folder).parquet(f"{self.folder}/batch=*").drop("batch")


def drain(stream: DataFrame, sink: BatchTable, checkpoint: str) -> None:
    """All that the source holds now, from where the checkpoint stands. State is in RocksDB, which timers need."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


NET = "path string, action string, at struct<ms:long,event_id:long>, n long"


def net(events: DataFrame, action: Column) -> DataFrame:
    """One row a path of a batch of (path, ms, event_id, ...): its last action, when that was and how many there were."""
    at = F.struct("ms", "event_id")
    return events.groupBy("path").agg(F.max_by(action, at).alias("action"), F.max(at).alias("at"), F.count("*").alias("n"))


class NetChanges(BatchTable):
    """Batches of events kept as one row a path; batches may come in any order, as events' own times decide."""

    def __init__(self, folder: str, action: Column):
        super().__init__(folder, NET)
        self.action = action

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        super().__call__(net(rows, self.action), batch_id)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).groupBy("path").agg(F.max_by("action", "at").alias("action"), F.sum("n").alias("n"))


def delay_ms(outcome: str, attempt: int, scale: int) -> int:
    seconds = LOCKED_S if outcome == "locked" else min(ERROR_S << min(attempt - 1, 10), MOST_ERROR_S)
    return seconds * 1000 * scale


def _frame(out: list[tuple]) -> pd.DataFrame:
    """Rows of RETRIES; texts as objects, as Arrow would make chunks of pandas' own strings."""
    return pd.DataFrame(out, columns=["path", "at_ms", "attempt", "what"]).astype({"path": object, "at_ms": "int64", "attempt": "int32", "what": object})


class Retrier(StatefulProcessor):
    """Per path: events not yet passed by the watermark, the run of equal failures, and when to try again."""

    def __init__(self, scale: int):
        self.scale = scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, event_id long, outcome string")
        self.run = handle.getValueState("run", "outcome string, n int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            values = list(zip(batch["ms"].tolist(), batch["event_id"].tolist(), batch["outcome"].tolist(), strict=True))
            if values:
                self.waiting.appendList(values)
                first = min([v[0] for v in values] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first)
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(v) for v in self.waiting.get()) if self.waiting.exists() else []
        outcome, n, due = self.run.get() if self.run.exists() else ("ok", 0, -1)
        out = []
        ready = [v for v in held if v[0] <= passed]
        for ms, _, now in ready:
            if 0 <= due < ms:
                out.append((key[0], due, n, "retry"))
            n, due = (n + 1 if now == outcome else 1), -1
            outcome = now
            if now == "locked" and n > LOCKED_TRIES:
                out.append((key[0], ms, n, "given up"))
                outcome, n = "ok", 0
            elif now != "ok":
                due = ms + delay_ms(now, n, self.scale)
        if 0 <= due <= passed:
            out.append((key[0], due, n, "retry"))
            due = -1
        rest = held[len(ready) :]
        if rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()
        if outcome == "ok":
            self.run.clear()
        else:
            self.run.update((outcome, n, due))
        after = [v[0] for v in rest[:1]] + ([due] if due >= 0 else [])
        if after:
            self.handle.registerTimer(min(after))
        yield _frame(out)

    def close(self) -> None:
        pass


def retries(events: DataFrame, scale: int = 1) -> DataFrame:
    """(path, at_ms, attempt, what) of a stream (path, ts with a watermark, ms, event_id, outcome): ok, locked or error.

    After a failure a path is tried again when its delay has passed without an event of it; attempts count equal
    failures in a row. A locked file is given up at the failure after LOCKED_TRIES tries, an error never.
    Events count in order of time and id once the watermark has passed them, in whatever batches they come.
    A path's events between the watermark and the newest batch are held in state, and sorted by one task.
    """
    rows = events.select("path", "ts", "ms", "event_id", "outcome")
    return rows.groupBy("path").transformWithStateInPandas(Retrier(scale), RETRIES, "append", "eventtime")
