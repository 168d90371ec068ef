"""Tables that are changed together: appended, replaced and deleted rows of one key, seen all at once.

A generation is a small file that names, for every table, the folders of rows that count and, for
the whole, the folders of keys that were taken out and when. Folders are never changed. A write
makes new folders first and then one new generation, by creating its file where there is none; of
two writers one succeeds and the other tries again on what the first left. A reader stays with the
generation that it opened, whatever is written meanwhile.

Rows of a key that was taken out in a later generation than theirs don't count. So a delete writes
keys alone, a replacement keys and new rows, and all tables that carry the key follow.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.store import tidied

TRIES = 20


@dataclass(frozen=True)
class Segment:
    """A folder of rows of generation `gen`; of a table in buckets, only those named count (None: all)."""

    path: str
    gen: int
    buckets: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Table:
    key: str
    bucket: str | None
    segments: tuple[Segment, ...] = ()
    #: Columns that rows of a bucket are sorted by.
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    gen: int
    tables: Mapping[str, Table] = field(default_factory=dict)
    #: (folder of keys, generation that took them out)
    gone: tuple[tuple[str, int], ...] = ()

    def to_json(self) -> str:
        tables = {n: {"key": t.key, "bucket": t.bucket, "order": t.order, "segments": [[s.path, s.gen, s.buckets and list(s.buckets)] for s in t.segments]} for n, t in self.tables.items()}
        return json.dumps({"gen": self.gen, "tables": tables, "gone": self.gone})

    @staticmethod
    def of(text: str) -> Manifest:
        raw = json.loads(text)
        segments = lambda rows: tuple(Segment(p, g, None if b is None else tuple(b)) for p, g, b in rows)
        tables = {n: Table(t["key"], t["bucket"], segments(t["segments"]), tuple(t["order"])) for n, t in raw["tables"].items()}
        return Manifest(raw["gen"], tables, tuple((p, g) for p, g in raw["gone"]))


class Generations:
    """The generations in one folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- generations

    def _name(self, gen: int) -> str:
        return f"{self.folder}/generations/{gen:012d}.json"

    def newest(self) -> Manifest:
        """The last generation; one without tables if there is none."""
        at = self._path(f"{self.folder}/generations")
        found = [f.getPath().toString() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        found = [f for f in found if f.endswith(".json")]
        return Manifest.of(self._read(max(found))) if found else Manifest(0)

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> bool:
        """Whether this writer was the one that made the generation. The text is written aside, whole, and gets
        its name by a link or rename that fails where the name is taken."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target = self._path(self._name(manifest.gen))
        aside = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}.json")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(manifest.to_json().encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # its rename would overwrite
                at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(at(target), at(aside))
            else:
                rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(aside, target, gateway.new_array(rename, 0))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True

    def commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Publishes what `change` makes of the newest generation; tried again on a newer one if another writer was first."""
        for _ in range(TRIES):
            made = change(self.newest())
            if self._publish(made):
                return made
        raise RuntimeError("too many writers")

    # ---- writing

    def _written(self, rows: DataFrame, name: str, partition: str | None = None) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        with tidied(self.spark):
            (writer.partitionBy(partition) if partition else writer).parquet(path)
        return path

    def create(self, tables: Mapping[str, tuple[str, str, str | None, tuple[str, ...]]]) -> Manifest:
        """The first generation: stored folders as they are. tables: name to (folder, key, bucket column or None,
        columns that rows of a bucket are sorted by)."""
        first = {n: Table(key, bucket, (Segment(path, 1),), order) for n, (path, key, bucket, order) in tables.items()}
        return self.commit(lambda m: Manifest(m.gen + 1, dict(first), ()))

    def write(self, rows: Mapping[str, DataFrame], gone: DataFrame | None = None) -> Manifest:
        """Adds rows to tables and takes the keys in `gone` out of all tables, in one generation.

        gone: one column. Keys whose rows are added too are replaced. Rows of a table must have its columns.
        """
        base = self.newest()
        paths = {n: self._written(df, n, base.tables[n].bucket) for n, df in rows.items()}
        keys = self._written(gone.toDF("key").filter("key is not null").distinct(), "gone") if gone is not None else None

        def change(m: Manifest) -> Manifest:
            gen, tables = m.gen + 1, dict(m.tables)
            for n, path in paths.items():
                t = tables[n]
                tables[n] = Table(t.key, t.bucket, (*t.segments, Segment(path, gen)), t.order)
            return Manifest(gen, tables, (*m.gone, (keys, gen)) if keys else m.gone)

        return self.commit(change)

    def compact(self, name: str, buckets: list[int]) -> Manifest:
        """Rewrites what counts in some buckets of a table as one folder; other buckets stay where they are."""
        m = self.newest()
        t, some = m.tables[name], tuple(sorted(buckets))
        live = self.rows(m, name).filter(F.col(t.bucket).isin(*some))
        # Folders are by bucket already, so what a task reads is a bucket's or a few buckets': nothing is shuffled.
        path = self._written(live.sortWithinPartitions(t.bucket, *t.order), name, t.bucket)
        held = {s.path: {int(b) for b in self._buckets(s.path, t.bucket)} if s.buckets is None else set(s.buckets) for s in t.segments}

        def left(s: Segment) -> Segment | None:
            rest = tuple(sorted(held[s.path] - set(some)))
            return Segment(s.path, s.gen, rest) if rest else None

        def change(now: Manifest) -> Manifest:
            if now.tables[name] != t or now.gone != m.gone:
                raise RuntimeError("written to meanwhile: compact again")
            gen, tables = now.gen + 1, dict(now.tables)
            kept = [x for x in map(left, t.segments) if x]
            tables[name] = Table(t.key, t.bucket, (*kept, Segment(path, gen, some)), t.order)
            return Manifest(gen, tables, now.gone)

        return self.commit(change)

    def _buckets(self, path: str, column: str) -> list[str]:
        prefix = f"{column}="
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(path))]
        return [n[len(prefix) :] for n in names if n.startswith(prefix)]

    def touched(self, m: Manifest, name: str) -> list[int]:
        """Buckets of a table that hold rows of more than one folder."""
        t = m.tables[name]
        seen: dict[int, int] = {}
        for s in t.segments:
            for b in self._buckets(s.path, t.bucket):
                if s.buckets is None or int(b) in s.buckets:
                    seen[int(b)] = seen.get(int(b), 0) + 1
        return sorted(b for b, n in seen.items() if n > 1)

    # ---- reading

    def gone(self, m: Manifest) -> DataFrame | None:
        """(key, out): keys that were taken out and the last generation that did so."""
        rows = None
        for path, gen in m.gone:
            own = self.spark.read.parquet(path).select("key", F.lit(gen).alias("out"))
            rows = own if rows is None else rows.unionByName(own)
        return None if rows is None else rows.groupBy("key").agg(F.max("out").alias("out"))

    def rows(self, m: Manifest, name: str, where: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The rows of a table that count in a generation. `where` filters each folder's rows before they meet
        the keys that were taken out."""
        t = m.tables[name]
        union, schema = None, None
        for s in t.segments:
            # The first folder has rows; of later ones, whose writes may have had none, it gives the schema.
            own = (self.spark.read.schema(schema) if union is not None else self.spark.read).parquet(s.path)
            schema = own.schema if union is None else schema
            if s.buckets is not None:
                own = own.filter(F.col(t.bucket).isin(*s.buckets))
            own = where(own).withColumn("_gen", F.lit(s.gen))
            union = own if union is None else union.unionByName(own)
        out = self.gone(m)
        if out is None:
            return union.drop("_gen")
        met = union.join(out, F.col(t.key) == F.col("key"), "left")
        return met.filter(F.col("out").isNull() | (F.col("_gen") >= F.col("out"))).drop("_gen", "key", "out")
