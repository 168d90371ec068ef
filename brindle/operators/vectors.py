"""Exact vector search by matrix products, and vector checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.sources.store import kept

#: About as many queries are sent to every task at once; a larger set goes in blocks.
MOST_QUERIES = 1_000


def blocks(queries: DataFrame, key: str) -> list[DataFrame]:
    """queries in blocks of about MOST_QUERIES rows, dealt by a hash of the key; at least one block."""
    n = max(1, -(-queries.count() // MOST_QUERIES))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [queries.filter(part == i) for i in range(n)] if n > 1 else [queries]


def knn(queries: DataFrame, vectors: DataFrame, k: int, group: int = 1) -> DataFrame:
    """(qid, id, sim, rank) by cosine, ties to the smaller id. Ids that give the query's own when divided by
    `group` don't count.

    queries: (qid, q); vectors: (id, v). Each block of queries goes to every task as a matrix; a task
    multiplies it with its vectors and keeps k a query, so what is shuffled doesn't grow with a partition.
    A block's results are stored before more are added to a plan. Null vectors, vectors with a null
    component and those of another length than the query's are no candidates.
    """
    numbers = ~F.exists("v", lambda x: x.isNull())
    pool = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & numbers)
    parts = blocks(queries.filter("qid is not null and q is not null"), "qid")
    found = [_scan(b, pool, k, group) for b in parts]
    rows = reduce(DataFrame.unionByName, [kept(f, "nearest") for f in found] if len(found) > 1 else found)
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))
    return rows.withColumn("rank", best).filter(F.col("rank") <= k)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _scan(queries: DataFrame, pool: DataFrame, k: int, group: int) -> DataFrame:
    """(qid, id, sim): each task's k best of one block of queries."""
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).collect()  # about MOST_QUERIES
    sides = {}
    for r in asked:
        sides.setdefault(len(r["q"]), []).append(r)
    matrices = [(w, np.array([r["qid"] for r in rows]), _units(np.array([r["q"] for r in rows], np.float64).reshape(len(rows), w))) for w, rows in sides.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(ids), -np.inf)) for _, ids, _ in matrices]
        for batch in batches:
            size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for n, (width, qids, q) in enumerate(matrices):
                own = batch.filter(pa.array(size == width))
                ids, x = own.column("id").to_numpy(), own.column("v").flatten().to_numpy().reshape(own.num_rows, width)
                for start in range(0, len(ids), 1024):
                    best[n] = _merged(best[n], qids, q, ids[start : start + 1024], _units(x[start : start + 1024]), k, group)
        for (_, qids, _), (at, ids, sims, _) in zip(matrices, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids), pa.array(sims)], ["qid", "id", "sim"])

    return pool.mapInArrow(run, "qid long, id long, sim double")


def _merged(best: tuple, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, group: int) -> tuple:
    new = np.round(q @ x.T, 6) + 0.0
    new[(qids // group)[:, None] == ids // group] = -np.inf
    return merged(best, np.arange(len(q)), ids, new, k)


def merged(best: tuple, rows: np.ndarray, ids: np.ndarray, new: np.ndarray, k: int) -> tuple:
    """The k best (query, id, score) of those so far and of new scores of some queries (rows) and all ids, and
    the least score of each query that has k."""
    at, old, scores, least = best
    cut = least[rows]
    if new.shape[1] > k:
        cut = np.maximum(cut, np.partition(new, new.shape[1] - k, axis=1)[:, new.shape[1] - k])
    r, c = np.nonzero((new >= cut[:, None]) & np.isfinite(new))
    at, old, scores = np.concatenate([at, rows[r]]), np.concatenate([old, ids[c]]), np.concatenate([scores, new[r, c]])
    order = np.lexsort((old, -scores, at))
    at, old, scores = at[order], old[order], scores[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep, full = place < k, place == k - 1
    least[at[full]] = np.maximum(least[at[full]], scores[full])
    return at[keep], old[keep], scores[keep], least


def nearest_to(vectors: DataFrame, q: list[float], k: int) -> DataFrame:
    """(id, sim): the k vectors of (id, v) nearest to one vector by cosine, ties to the smaller id."""
    rated = vectors.select("id", F.round(V.cosine(F.lit(q), F.col("v")), 6).alias("sim"))
    return rated.orderBy(F.desc("sim"), "id").limit(k)


def centroids(vectors: DataFrame, group: str, column: str) -> DataFrame:
    """(group, pos, mean): the mean vector of each group, one row a coordinate."""
    return vectors.select(group, F.posexplode(column).alias("pos", "x")).groupBy(group, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def bad(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of vectors that are missing, empty or not finite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(column).isNull() | (F.size(column) == 0) | odd).select(key)
