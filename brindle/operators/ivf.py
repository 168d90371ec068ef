"""Approximate vector search by cells and residual product codes, re-scored exactly.

Vectors of unit length are dealt to the cells of a coarse codebook; what is left of a vector after
its cell's centre is taken away is coded in parts of a byte each. The index is a table in folders
by cell, codes beside ids, vectors in a column that a search reads for its short list only. A
query reads the cells nearest to it: within a task that holds one cell's rows, a table of
distances from the query's residual to every code entry makes a row's estimate a sum of lookups.
The best estimates are scored again from the vectors.

Codebooks are fitted to a sample of bounded size; every row is indexed. How many cells a search reads is
measured: the least number that finds the share asked for of an exact scan's answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.vectors import cosine
from brindle.operators import vectors as exact
from brindle.sources.store import kept, shared_dir

#: Rows that codebooks are fitted to, for each cell, and at most; rounds of fitting.
SAMPLE_A_CELL, MOST_SAMPLE, ROUNDS = 64, 262_144, 8
MOST_CELLS = 4_096
PARTS, ENTRIES = 16, 256
#: Estimates that are scored again, for each answer asked for.
SHORT_LIST = 20
#: Sampled queries that the number of cells is measured with, and the share of answers to find.
MEASURED, RECALL = 128, 0.95
#: Rows of a cell in one task; a larger cell is dealt to several.
CELL_ROWS = 65_536
#: Groups that cells are dealt to; each is a task, or several.
SHELVES = 64
#: Queries whose short lists a task keeps at once.
QUERIES = 128


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of unit length; a row of zeros stays one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    out = np.empty(len(x), np.int64)
    for start in range(0, len(x), 8192):
        out[start : start + 8192] = (x[start : start + 8192] @ centres.T - half).argmax(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k centres of the rows; a centre that loses all its rows takes one at random."""
    r = np.random.default_rng(seed)
    centres = x[r.permutation(len(x))[:k]].astype(np.float32)
    for _ in range(rounds):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros(centres.shape)
        np.add.at(total, at, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[r.integers(0, len(x), len(centres))]).astype(np.float32)
    return centres


@dataclass
class Model:
    """Coarse centres, and for each part of the dimensions a codebook of residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def cuts(self) -> list[int]:
        return [0, *np.cumsum([b.shape[1] for b in self.books]).tolist()]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        left, cuts = x - self.centres[cell], self.cuts
        return cell, np.column_stack([_nearest(left[:, a:b], book).astype(np.uint8) for a, b, book in zip(cuts, cuts[1:], self.books, strict=False)])

    def estimates(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the rows that codes stand for: the centre's part and a lookup a code."""
        cuts = self.cuts
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1).astype(np.float32)
        for p, (a, b, book) in enumerate(zip(cuts, cuts[1:], self.books, strict=False)):
            out += (q[:, a:b] @ book.T)[:, codes[:, p]]
        return out

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n cells nearest to each query."""
        score = q @ self.centres.T - (self.centres**2).sum(1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, cells: int) -> Model:
    """A model of the sample's rows, which are of unit length."""
    centres = k_means(sample, cells)
    left = sample - centres[_nearest(sample, centres)]
    width = sample.shape[1]
    cuts = [width * p // min(PARTS, width) for p in range(min(PARTS, width) + 1)]
    return Model(centres, [k_means(np.ascontiguousarray(left[:, a:b]), min(ENTRIES, len(left)), seed=a + 2) for a, b in zip(cuts, cuts[1:], strict=False)])


class Index:
    """A stored index: its folder, model, rows when it was fitted, and cells that a search reads."""

    def __init__(self, spark: SparkSession, path: str, model: Model, trained_rows: int, probes: int):
        self.spark, self.path, self.model, self.trained_rows, self.probes = spark, path, model, trained_rows, probes

    @property
    def table(self) -> DataFrame:
        """(cell, id, code, v) of all rows."""
        reader = self.spark.read.schema("id long, code binary, v array<double>, cell int, part int")
        return reduce(DataFrame.unionByName, [reader.parquet(f) for f in self._folders()])

    def _folders(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().toString() for f in fs.listStatus(at))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, id, sim, rank): the k best found of each query (qid, q) by cosine, ties to the smaller id, its
        own id left out. Queries of another length find nothing. Unless given, as many cells are read as the index measured."""
        model, n = self.model, min(probes or self.probes, len(self.model.centres))
        queries = queries.filter(F.size("q") == self.model.centres.shape[1])
        most = SHORT_LIST * k

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = unit_rows(batch.column("q"))
                if len(q):
                    at = model.probes(q, n)
                    again = np.repeat(np.arange(len(q)), at.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("qid").take(again), pa.array(at.ravel().astype(np.int32)), batch.column("q").take(again)], ["qid", "cell", "q"])

        asked = queries.select("qid", F.col("q").cast("array<double>").alias("q")).mapInArrow(spread, "qid long, cell int, q array<double>")

        def shortest(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            """Each query's best estimates in the task's cells together."""
            schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("estimate", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            names, at = np.unique(left.column("qid").to_numpy(), return_inverse=True)
            asked, q = left.column("cell").to_numpy(), unit_rows(left.column("q").combine_chunks())
            cells, ids = right.column("cell").to_numpy(), right.column("id").to_numpy()
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            found = []
            for first in range(0, len(names), QUERIES):  # few queries at a time, so that their short lists are sorted quickly
                here = np.flatnonzero((at >= first) & (at < first + QUERIES))
                size = min(QUERIES, len(names) - first)
                best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.full(size, -np.inf, np.float32))
                for cell in np.unique(asked[here]):
                    mine, own = here[asked[here] == cell], np.flatnonzero(cells == cell)
                    for part in np.array_split(own, -(-len(own) // 8192)) if len(own) else ():
                        score = model.estimates(q[mine], int(cell), codes[part])
                        score[names[at[mine]][:, None] == ids[part]] = -np.inf
                        best = exact.merged(best, at[mine] - first, ids[part], score, most)
                found.append(pa.table([names[first + best[0]], best[1], best[2].astype(np.float64)], schema=schema))
            return pa.concat_tables(found)

        asked = kept(asked, "asked")
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
        read = lambda *columns: self.table.filter(F.col("cell").isin(cells)).select(*columns)
        # Cells of a shelf share a task, which keeps one short list a query; a large cell is dealt to several tasks,
        # and the queries that read it go to each of them.
        shelf = F.pmod("cell", F.lit(SHELVES)).alias("shelf")
        codes = read(shelf, "part", "cell", "id", "code")
        parts = read("cell", "part").distinct()
        near = asked.join(parts, "cell").withColumn("shelf", shelf).groupBy("shelf", "part").cogroup(codes.groupBy("shelf", "part")).applyInArrow(shortest, "qid long, id long, estimate double")
        first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("estimate"), "id"))
        few = near.withColumn("r", first).filter(F.col("r") <= most).select("qid", "id")
        scored = few.join(read("id", "v"), "id").join(queries.select("qid", "q"), "qid")
        sim = F.round(cosine(F.col("q"), F.col("v")), 6).alias("sim")
        last = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))
        return scored.select("qid", "id", sim).withColumn("rank", last).filter(F.col("rank") <= k)

    def append(self, rows: DataFrame) -> Index:
        """The index with more (id, v) rows; fitted anew once it has twice the rows that it was fitted to."""
        _write(rows, self.model, self.path)
        total = self.table.count()
        if total >= 2 * self.trained_rows:
            return build(self.table.select("id", "v"))
        return self


def _write(rows: DataFrame, model: Model, path: str) -> None:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = model.encode(unit_rows(batch.column("v")))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), packed, batch.column("v")], ["cell", "id", "code", "v"])

    schema = T._parse_datatype_string("cell int, id long, code binary, v array<double>")
    coded = rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(code, schema)
    name = f"{path}/rows/{uuid.uuid4().hex}"
    coded = kept(coded, "coded")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part")
    dealt = coded.join(F.broadcast(sizes), "cell").select("cell", part, "id", "code", "v")  # a row a cell: MOST_CELLS at most
    dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").write.partitionBy("cell", "part").option("compression", "zstd").parquet(name)


def usable(rows: DataFrame) -> DataFrame:
    """(id, v) rows whose vector isn't null, empty, all zero or holds what isn't finite."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def build(rows: DataFrame, cells: int | None = None, k: int = 10, recall: float = RECALL) -> Index:
    """An index of (id, v) rows, in a new folder of the cluster's shared one.

    Unless given, there are the square root of the rows as cells, MOST_CELLS at most. Vectors that are
    unusable, or of another length than most, are left out. No rows give an index that finds nothing.
    """
    spark, good = rows.sparkSession, usable(rows)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = lengths[0]["n"] if lengths else 1
    good = good.filter(F.size("v") == width)
    total = lengths[0]["count"] if lengths else 0
    cells = max(1, min(cells or int(total**0.5), MOST_CELLS, max(1, total // 8)))
    most = min(MOST_SAMPLE, SAMPLE_A_CELL * cells)
    # The sample is by a hash of the id, so it is the same in every run.
    share = min(1.0, 1.2 * most / max(total, 1))
    drawn = good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    sample = unit_rows(drawn.column("v").combine_chunks()) if drawn.num_rows else np.zeros((1, width), np.float32)
    model = fit(sample, min(cells, len(sample)))
    index = Index(spark, f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}", model, total, 1)
    _write(good, model, index.path)
    index.probes = _measured(index, good, k, recall)
    return index


def _measured(index: Index, rows: DataFrame, k: int, recall: float) -> int:
    """Cells to read for the share asked for of MEASURED sampled queries' answers: as many as hold that share of
    them, doubled while a search finds fewer, as estimates lose some."""
    drawn = rows.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(MEASURED).select(F.col("id").alias("qid"), F.col("v").cast("array<double>").alias("q")).toArrow()
    if not drawn.num_rows:
        return 1
    asked = rows.sparkSession.createDataFrame(drawn)
    right = exact.knn(asked, rows.select("id", "v"), k).select("qid", "id", "sim")
    where = right.join(index.table.select("id", "cell"), "id").collect()  # k rows a sampled query, and repeated ids
    cells, qids, q = len(index.model.centres), drawn.column("qid").to_pylist(), unit_rows(drawn.column("q").combine_chunks())
    order = dict(zip(qids, index.model.probes(q, cells).argsort(axis=1), strict=True))  # the place of each cell
    places = sorted(int(order[r["qid"]][r["cell"]]) + 1 for r in where)
    n = places[min(len(places) - 1, int(np.ceil(recall * len(places))))] if places else cells
    least, total = {}, 0
    for r in where:
        least[r["qid"]] = min(r["sim"], least.get(r["qid"], 2.0))
    total = min(k * len(least), len(where))
    while n < cells:
        hits = sum(r["sim"] >= least.get(r["qid"], 2.0) for r in index.search(asked, k, n).select("qid", "sim").collect())
        if hits >= recall * total:
            break
        n *= 2
    return min(n, cells)
