"""Streams of changes: replayed batches, restarts in the middle, locked files, late order; all equal a plain pass over the events."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from brindle.streaming import watch, windows

LATE = "60 seconds"


def plain(events, passed):
    """Retries by the rule, one path after another in order of time."""
    out = []
    for path in {e[0] for e in events}:
        run, n = "ok", 0
        own = sorted(e[1:] for e in events if e[0] == path)
        for i, (ms, _, outcome) in enumerate(own):
            n, run = (n + 1 if outcome == run else 1), outcome
            if outcome == "ok":
                continue
            if outcome == "locked" and n == 5:
                out.append((path, ms, 5, "given up"))
                run, n = "ok", 0
                continue
            due = ms + 1000 * (30 if outcome == "locked" else (30, 60, 120, 240, 480, 600)[min(n, 6) - 1])
            if i + 1 == len(own) or own[i + 1][0] > due:
                out.append((path, due, n, "retry"))
    return sorted(x for x in out if x[1] <= passed)


def stream(spark, folder, schema):
    rows = windows.timed(windows.event_stream(spark, folder, schema, 1), LATE)
    return rows.withColumn("ms", F.unix_millis("ts"))


@pytest.fixture(scope="module")
def batches():
    """Files of events, in the order of files; inside the watermark's minute the files overlap."""
    r, out, at, n = random.Random(7), [], 1_700_000_000_000, 0
    for _ in range(3):
        rows = []
        for _ in range(40):
            at += r.choice([0, 500, 5_000, 40_000])
            rows.append((r.choice(["hot", "hot", "a", "b", "c"]), at - r.randrange(0, 20_000), n, r.choice(["ok", "locked", "locked", "locked", "locked", "error", "error"])))
            n += 1
        out.append(rows)
    # One path that stays locked throughout, and an event long after all others, which lets the watermark pass them.
    out[1] += [("shut", at - 900_000 + 31_000 * i, 900 + i, "locked") for i in range(4)]
    out[1] = [e for e in out[1] if e[1] > max(x[1] for x in out[0]) - 60_000]
    out.append([("end", at + 10_000_000, 1_000, "ok")])
    return out


def test_restart_and_replay(spark, batches):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    make = lambda rows: spark.createDataFrame(rows, "path string, ms long, event_id long, outcome string").select("path", F.timestamp_millis("ms").alias("ts"), "event_id", "outcome")
    schema = make(batches[0]).schema
    tries = watch.BatchTable(f"{folder}/tries", watch.RETRIES)
    net = watch.NetChanges(f"{folder}/net", F.col("outcome"))
    for i, rows in enumerate(batches):  # a run ends after each file; the next one starts from the checkpoint
        make(rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i != 1:  # two files at once, one after the other
            watch.drain(watch.retries(stream(spark, f"{folder}/in", schema)), tries, f"{folder}/c1")
            watch.drain(stream(spark, f"{folder}/in", schema), net, f"{folder}/c2")
    events = [e for b in batches for e in b]
    found = [tuple(x) for x in tries.rows(spark).collect()]
    assert sorted(found) == plain(events, max(e[1] for e in events) - 60_000)
    assert {"retry", "given up"} == {x[3] for x in found}

    def current():
        return sorted(tuple(x) for x in net.current(spark).collect())

    last = {}
    for p, ms, i, outcome in events:
        last[p] = max(last.get(p, (0, 0, "")), (ms, i, outcome))
    right = sorted((p, x[2], sum(e[0] == p for e in events)) for p, x in last.items())
    assert current() == right
    # The second batch is applied again, as after a crash between its write and the checkpoint's.
    ids = sorted(r[0] for r in spark.read.parquet(f"{folder}/net").select("batch").distinct().collect())
    again = next(b for b in batches if {e[2] for e in b} & {40})
    net(make(again).withColumn("ms", F.unix_millis("ts")), ids[1])
    assert current() == right


def test_nothing_comes(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    none = spark.createDataFrame([], "path string, ts timestamp, event_id long, outcome string")
    none.write.parquet(f"{folder}/in")
    tries = watch.BatchTable(f"{folder}/tries", watch.RETRIES)
    watch.drain(watch.retries(stream(spark, f"{folder}/in", none.schema)), tries, f"{folder}/c")
    tries(spark.createDataFrame([], watch.RETRIES), 0)
    assert tries.rows(spark).count() == 0
