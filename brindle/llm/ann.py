"""Approximate nearest neighbours by a navigable small-world graph for each shard of the vectors.

Equal vectors are indexed once. The distinct ones are dealt to shards by hash, and each shard
becomes a hierarchy of graphs, stored as flat arrays of neighbours. Largest inner product is
made a nearest-neighbour question by one more coordinate that gives all vectors the same norm.
Queries go to every shard in blocks; each shard returns its best, and the best of all shards
are found by a window over each query. Scores are inner products of the original vectors in
double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.scratch import Scratch

#: Most distinct vectors in a shard, and the fewest shards a large table is dealt to.
SHARD_ROWS = 8_192
SHARDS = 8
#: Queries that meet a shard at once: a block is about as large as a quarter of a shard, so that a shard
#: is sent to few tasks.
BLOCK = 16_384
#: Neighbours of a vector in upper graphs and twice as many in the lowest; width of searches.
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
#: Each shard's width of searches is fitted: so many of its vectors are searched and scanned exactly, and the
#: width doubles until the share of their k nearest that is found is this. From a quarter of the shard on,
#: a scan is cheaper.
FIT_QUERIES = 64
FIT_RECALL = 0.98


def _without_repeats(pool: np.ndarray) -> np.ndarray:
    """pool with -1 for each number that a row already holds."""
    order = np.argsort(pool, axis=1, kind="stable")
    ranked = np.take_along_axis(pool, order, 1)
    again = np.zeros(pool.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    ranked[again] = -1
    out = np.empty_like(pool)
    np.put_along_axis(out, order, ranked, 1)
    return out


class Graph:
    """Hierarchical navigable small-world graph over unit-norm float32 rows, with int32 neighbour arrays.

    Level k holds a random 1 / LINKS of level k - 1. Vectors go in by batches: a batch searches the
    graph as it stands, all of its vectors at once, and is then linked both ways.
    """

    def __init__(self, x: np.ndarray, levels: np.ndarray, neighbours: list[np.ndarray]):
        self.x, self.levels, self.neighbours = x, levels, neighbours

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Graph:
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        levels = np.minimum(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS), 6).astype(np.int32)
        order = np.argsort(-levels, kind="stable")  # upper levels first, so that entry points are there
        x, levels = x[order], levels[order]
        graph = cls(x, levels, [np.full((int((levels >= k).sum()), LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)])
        done = 0
        while done < n:
            size = max(1, min(512, done))
            graph._insert(done, min(n, done + size))
            done = min(n, done + size)
        graph.order = order
        return graph

    def _insert(self, start: int, stop: int) -> None:
        new = np.arange(start, stop)
        top = len(self.neighbours) - 1
        entry = np.zeros((len(new), 1), np.int32)
        for level in range(top, -1, -1):
            here = self.levels[new] >= level
            size = int((self.levels[:start] >= level).sum())
            if size:
                ids, scores = self._beam(self.x[new], entry, level, BUILD_WIDTH if here.any() else 1, start)
                entry = ids[:, :1].copy()
            if not here.any():
                continue
            own = new[here]
            fellows = own if len(own) > 1 else own[:0]
            pool = ids[here] if size else np.full((len(own), 1), -1, np.int32)
            score = scores[here] if size else np.full((len(own), 1), -np.inf, np.float32)
            if len(fellows):  # vectors of the batch may be each other's nearest
                mutual = self.x[own] @ self.x[fellows].T
                np.fill_diagonal(mutual, -np.inf)
                take = min(16, len(fellows))
                best = np.argpartition(-mutual, take - 1, axis=1)[:, :take]
                pool = np.concatenate([pool, fellows[best].astype(np.int32)], axis=1)
                score = np.concatenate([score, np.take_along_axis(mutual, best, axis=1)], axis=1)
                score[pool == own[:, None]] = -np.inf
            chosen = self._diverse(pool, score, self.neighbours[level].shape[1] // 2 if level == 0 else LINKS)
            width = self.neighbours[level].shape[1]
            self.neighbours[level][own, : chosen.shape[1]] = chosen[:, :width]
            self._link_back(level, own, chosen)

    def _diverse(self, pool: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, up to `most` that are nearer to the row than to one
        already taken; places that stay free go to the best of the others."""
        pool = _without_repeats(pool)
        score = np.where(pool < 0, -np.inf, score)
        order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * most]
        pool, score = np.take_along_axis(pool, order, 1), np.take_along_axis(score, order, 1)
        rows, width = pool.shape
        vectors = self.x[np.maximum(pool, 0)]
        between = np.einsum("rid,rjd->rij", vectors, vectors)
        taken = np.zeros((rows, width), bool)
        count = np.zeros(rows, np.int64)
        for i in range(width):
            near = np.where(taken, between[:, i], -np.inf).max(axis=1)
            ok = (near < score[:, i]) & (count < most) & np.isfinite(score[:, i])
            taken[:, i] = ok
            count += ok
        rank = np.where(taken, 0, np.where(np.isfinite(score), 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(pool, pick, 1).astype(np.int32)
        out[~np.isfinite(np.take_along_axis(score, pick, 1))] = -1
        return out

    def _link_back(self, level: int, own: np.ndarray, chosen: np.ndarray) -> None:
        table = self.neighbours[level]
        source = np.repeat(own, chosen.shape[1]).astype(np.int32)
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max())
        added = np.full((len(nodes), width), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        added[np.repeat(np.arange(len(nodes)), count), place] = source
        pool = _without_repeats(np.concatenate([table[nodes], added], axis=1))
        used = (pool >= 0).sum(axis=1)
        room = used <= table.shape[1]
        tight = np.argsort(pool[room] < 0, axis=1, kind="stable")[:, : table.shape[1]]
        table[nodes[room]] = np.take_along_axis(pool[room], tight, 1)
        full = np.flatnonzero(~room)
        for part in np.array_split(full, max(1, len(full) // 256)):
            if len(part):
                some = pool[part]
                score = np.einsum("rd,rjd->rj", self.x[nodes[part]], self.x[np.maximum(some, 0)])
                kept = self._diverse(some, np.where(some < 0, -np.inf, score), table.shape[1])
                table[nodes[part]] = -1
                table[nodes[part], : kept.shape[1]] = kept

    def _beam(self, q: np.ndarray, entry: np.ndarray, level: int, width: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best found for each query on one level, best first, -1 where there are fewer."""
        table, rows = self.neighbours[level], np.arange(len(q))
        ids = np.full((len(q), width), -1, np.int32)
        scores = np.full((len(q), width), -np.inf, np.float32)
        open_ = np.zeros((len(q), width), bool)
        seen = np.zeros((len(q), max(known, 1)), bool)
        ids[:, 0] = entry[:, 0]
        scores[:, 0] = np.einsum("rd,rd->r", q, self.x[entry[:, 0]])
        open_[:, 0] = True
        seen[rows, entry[:, 0]] = True
        active = rows
        while len(active):
            waiting = np.where(open_[active], scores[active], -np.inf)
            at = waiting.argmax(axis=1)
            go = np.isfinite(waiting[np.arange(len(active)), at])
            active, at = active[go], at[go]
            if not len(active):
                break
            open_[active, at] = False
            near = table[ids[active, at]]
            fresh = (near >= 0) & (near < known)
            fresh &= ~seen[active[:, None], np.where(fresh, near, 0)]
            r, c = np.nonzero(fresh)
            to = near[r, c]
            seen[active[r], to] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("rd,rd->r", q[active[r]], self.x[to])
            some = np.concatenate([scores[active], value], axis=1)
            best = np.argpartition(-some, width - 1, axis=1)[:, :width] if some.shape[1] > width else np.argsort(-some, axis=1)
            scores[active] = np.take_along_axis(some, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), best, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], np.isfinite(value)], axis=1), best, 1)
        order = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def fitted_width(self, k: int, width: int = SEARCH_WIDTH) -> int:
        """The least of width, 2 * width, ... that finds FIT_RECALL of the k nearest of a sample."""
        n = len(self.x)
        q = self.x[:: max(1, n // FIT_QUERIES)][:FIT_QUERIES]
        k = min(k, n)
        exact = q @ self.x.T
        least = np.partition(exact, n - k, axis=1)[:, n - k, None] - 1e-6
        while width * 4 < n:
            found = self.search(q, k, width)[1]
            if (found >= least).mean() >= FIT_RECALL:
                break
            width *= 2
        return width

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best found for each query; -1 where there are fewer."""
        n = len(self.x)
        if width * 4 >= n:
            scores = q @ self.x.T
            ids = np.argsort(-scores, axis=1, kind="stable")[:, :k].astype(np.int32)
            return ids, np.take_along_axis(scores, ids, 1)
        entry = np.zeros((len(q), 1), np.int32)
        for level in range(len(self.neighbours) - 1, 0, -1):
            entry = self._beam(q, entry, level, 4, n)[0][:, :1]
        ids, scores = self._beam(q, entry, 0, max(k, width), n)
        return ids[:, :k], scores[:, :k]


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of vectors that take part: not null, not zero, all components finite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    # -0.0 and 0.0 are one number: equal vectors are to be equal arrays.
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + 0.0))


def _unit(x: np.ndarray, scale: float, radius: float) -> np.ndarray:
    """Vectors of length 1: x / scale / radius, and one more coordinate that evens out the norms."""
    y = x / scale / radius
    return np.column_stack([y, np.sqrt(np.maximum(1 - (y**2).sum(axis=1), 0))]).astype(np.float32)


def build_index(distinct: DataFrame, scale: float, radius: float, k: int) -> DataFrame:
    """(shard, ids, vectors, levels, neighbours, dim, width) from (shard, id, v): one row of flat arrays a shard."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.array(group["v"].tolist(), np.float64)
        graph = Graph.build(_unit(x, scale, radius))
        return pd.DataFrame(
            {
                "shard": [group["shard"].iloc[0]], "ids": [group["id"].to_numpy(np.int64)[graph.order].tobytes()],
                "vectors": [x[graph.order].tobytes()], "levels": [graph.levels.tobytes()],
                "neighbours": [[t.tobytes() for t in graph.neighbours]], "dim": [x.shape[1]], "width": [graph.fitted_width(k)],
            }
        )

    return distinct.groupBy("shard").applyInPandas(
        build, "shard long, ids binary, vectors binary, levels binary, neighbours array<binary>, dim int, width int"
    )


def search_shards(blocks: DataFrame, index: DataFrame, scale: float, radius: float, k: int, width: int) -> DataFrame:
    """(query_id, id, score) of each query's best k in each shard; a task holds one shard and one block."""

    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(queries) or not len(shard):
            return empty
        s = shard.iloc[0]
        x = np.frombuffer(s["vectors"], np.float64).reshape(-1, s["dim"])
        ids, levels = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["levels"], np.int32)
        q = np.array(queries["v"].tolist(), np.float64)
        if q.shape[1] != s["dim"]:
            return empty
        tables = [np.frombuffer(t, np.int32).reshape(-1, LINKS * (2 if i == 0 else 1)) for i, t in enumerate(s["neighbours"])]
        graph = Graph(_unit(x, scale, radius), levels, tables)
        found = []
        for part in np.array_split(np.arange(len(q)), max(1, -(-len(q) // 256))):
            own = q[part] / np.abs(q[part]).max(axis=1, keepdims=True)
            unit = np.column_stack([own / np.linalg.norm(own, axis=1)[:, None], np.zeros(len(part))])
            at, _ = graph.search(unit.astype(np.float32), k, max(width, int(s["width"])))
            r, c = np.nonzero(at >= 0)
            to = at[r, c]
            score = np.einsum("rd,rd->r", q[part][r], x[to])
            found.append(pd.DataFrame({"query_id": queries["query_id"].to_numpy()[part][r], "id": ids[to], "score": score}))
        return pd.concat(found)

    return blocks.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(search, "query_id long, id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of vectors but itself, as found.

    Nearness is the inner product, ties go to the smaller vec_id. Vectors that are null, zero or not
    finite, and rows without a key, take no part. Vectors of another length than the query's are no
    candidates. Of rows that repeat a vec_id each counts, but a query's own id is never its candidate.
    An empty table, or one without queries, gives an empty result; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.save(usable(vectors, key, column).withColumn("same", F.xxhash64("v")), "rows")
    # Members of a class of equal vectors: the k + 1 least ids are all that a result can need.
    ranked = rows.groupBy("same", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = scratch.save(ranked, "classes")
    # Norms are of vectors over the largest component of all, so that no square overflows.
    total, scale = classes.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    part = lambda x: x / F.lit(scale)
    radius = classes.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + part(x) * part(x))))).first()[0] * (1 + 1e-9)
    shards = max(-(-total // SHARD_ROWS), min(SHARDS, -(-total // 256)))
    dims = F.size("v").cast("long") * 1_000_003  # a shard holds vectors of one length
    placed = classes.select((dims + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards))).alias("shard"), "id", "v")
    index = scratch.save(build_index(placed, scale, radius, k + 1), "index")
    asked = usable(queries, key, column).select(F.col("vec_id").alias("query_id"), "v").distinct()
    n_blocks = F.lit(max(1, -(-asked.count() // BLOCK)))
    block = F.pmod(F.xxhash64("query_id", F.lit(11)), n_blocks)
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: dims + i))
    blocks = asked.select("query_id", "v", block.alias("block"), every.alias("shard"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1).cast("array<bigint>")))
    # One more than k: the query's own class may be among them.
    found = search_shards(blocks, copies, scale, radius, k + 1, max(width, k + 1))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    classes_found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    member = _least_members(rows, classes, k + 1)
    met = classes_found.join(member, "id").filter("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least_members(rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(id, vec_id): of each class of equal vectors, named by its least id, the k least ids.

    Classes of one are their own. Ids of larger ones are ranked within 64 parts first, so that no
    task ranks a whole large class.
    """
    single = classes.filter("n = 1").select("id", F.col("id").alias("vec_id"))
    many = rows.join(classes.filter("n > 1").select("same", F.col("v").alias("w"), "id"), "same").filter("v = w").select("id", "vec_id")
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(64)).alias("part")
    first = F.row_number().over(Window.partitionBy("id", "part").orderBy("vec_id"))
    few = many.select("id", "vec_id", part).withColumn("r", first).filter(F.col("r") <= k)
    last = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    return single.unionByName(few.withColumn("r", last).filter(F.col("r") <= k).select("id", "vec_id"))
