"""Queries on streams of changes to watched files: each runs its stream to the end of the table and reads what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.queries.registry import query
from brindle.sources.corpus import Corpus
from brindle.sources.store import shared_dir
from brindle.streaming import watch, windows

LATE_MS = 600_000
#: Events of a user are hours apart, so delays are made that much longer.
SCALE = 240


def _watched(c: Corpus):
    events = windows.timed(windows.event_stream(c.spark, f"{c.sf_dir}/events.parquet", c.table("events").schema), f"{LATE_MS} milliseconds")
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("view", "click"), "locked").otherwise("ok")
    return events.select(F.col("user_id").cast("string").alias("path"), "ts", F.unix_millis("ts").alias("ms"), "event_id", "event_type", outcome.alias("outcome"))


@query("watch_apply", "SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN arg_max(event_type, (epoch_us(ts) // 1000, event_id)) = 'error' THEN 'delete' ELSE 'upsert' END AS action, count(*) AS n FROM events GROUP BY 1")
def watch_apply(c: Corpus):
    folder = f"{shared_dir(c.spark)}/watch-{uuid.uuid4().hex}"
    sink = watch.NetChanges(f"{folder}/net", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    watch.drain(_watched(c), sink, f"{folder}/checkpoint")
    return sink.current(c.spark)


RETRIED = f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) // 1000 AS ms, event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('view', 'click') THEN 'locked' ELSE 'ok' END AS outcome FROM events),
g AS (SELECT *, lead(ms) OVER w AS next_ms, CASE WHEN outcome = lag(outcome) OVER w THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ms, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY ms, event_id) AS k FROM i),
a AS (SELECT path, ms, next_ms, outcome, CAST(CASE WHEN outcome = 'locked' THEN (k - 1) % {watch.LOCKED_TRIES + 1} + 1 ELSE k END AS INT) AS attempt FROM r WHERE outcome <> 'ok'),
d AS (SELECT *, ms + 1000 * {SCALE} * CASE WHEN outcome = 'locked' THEN {watch.LOCKED_S} ELSE least({watch.ERROR_S} * CAST(pow(2, least(attempt - 1, 10)) AS BIGINT), {watch.MOST_ERROR_S}) END AS due FROM a),
w AS (SELECT path, CASE WHEN outcome = 'locked' AND attempt > {watch.LOCKED_TRIES} THEN ms ELSE due END AS at_ms, attempt, CASE WHEN outcome = 'locked' AND attempt > {watch.LOCKED_TRIES} THEN 'given up' ELSE 'retry' END AS what, next_ms FROM d)
SELECT path, at_ms, attempt, what FROM w WHERE (what = 'given up' OR next_ms IS NULL OR next_ms > at_ms) AND at_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events) - {LATE_MS}
"""


@query("watch_retries", RETRIED)
def watch_retries(c: Corpus):
    # What the watermark has passed at the end of the table: ten minutes before the last event.
    folder = f"{shared_dir(c.spark)}/watch-{uuid.uuid4().hex}"
    sink = watch.BatchTable(f"{folder}/retries", watch.RETRIES)
    watch.drain(watch.retries(_watched(c), SCALE), sink, f"{folder}/checkpoint")
    return sink.rows(c.spark)
