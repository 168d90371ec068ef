"""Derived tables, written once in the folder that the cluster shares and read by every query after.

A table's folder is named by VERSION and by the path, size and time of the files that it is derived
from, so a changed input is a new folder and never meets an old index.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

VERSION = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one for a single process alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is written inside deletes its shuffles as it ends; the session is as it was afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Folders of kept tables that the process still has, by path.
_LIVE: dict[str, SparkSession] = {}


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own and read again, which cuts its lineage. drop() deletes it; what is left goes at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(_drop_live)
    _LIVE[path] = spark
    with tidied(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for path in (df._kept_path for df in frames):
        spark = _LIVE.pop(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_live() -> None:
    for path, spark in list(_LIVE.items()):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            return


class Store:
    """The derived tables of some input files."""

    def __init__(self, spark: SparkSession, inputs: list[str]):
        self.spark, self.inputs = spark, inputs
        self._folder: str | None = None
        #: Bytes of the inputs, known once the folder is.
        self.bytes = 0

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def folder(self) -> str:
        if self._folder is None:
            seen = []
            for path in self.inputs:
                at, fs = self._files(path)
                found = fs.listFiles(at, True)
                while found.hasNext():
                    f = found.next()
                    seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
                    self.bytes += f.getLen()
            key = hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()
            self._folder = f"{shared_dir(self.spark)}/index-{VERSION}-{key}"
        return self._folder

    def has(self, name: str) -> bool:
        at, fs = self._files(f"{self.folder}/{name}")
        return fs.exists(at)

    def table(self, name: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
        """The stored table; if there is none yet, build() is written first. Of two writers the first stands."""
        path = f"{self.folder}/{name}"
        at, fs = self._files(path)
        if not fs.exists(at):
            own = f"{self.folder}-{name}-{uuid.uuid4().hex}"
            writer = build().write.option("compression", "zstd")
            with tidied(self.spark):
                (writer.partitionBy(partition) if partition else writer).parquet(own)
            made, _ = self._files(own)
            fs.mkdirs(at.getParent())
            if not fs.exists(at):
                fs.rename(made, at)
            else:
                fs.delete(made, True)
        return self.spark.read.parquet(path)
