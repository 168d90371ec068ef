"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one process alone (as in tests) gets a temporary
    folder; on a cluster that is an error, since executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Keeps Arrow batches to so many rows, for functions whose results are much larger than their input."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Tables that one operator call writes to cut its lineage.

    A written table survives the loss of executors, is read with pruned columns, and is
    dropped when the call no longer needs it; what the result still reads goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop_all)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with self.tidied():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    @contextmanager
    def tidied(self) -> Iterator[None]:
        """What runs inside deletes its shuffles as it ends; the session is as it was afterwards."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def drop_all(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
