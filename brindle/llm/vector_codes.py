"""Vectors as product codes: the index of the nearest codebook entry for each part of a vector.

Components become integers, so that all distances are exact. The nearest entry of a part is found
by slices: each coordinate of the codebook is sorted, and each place in that order carries a mask
of the entries before it. A radius around a part selects a range in every coordinate; the masks at
its two ends differ in the entries inside, and the masks of all coordinates, ANDed, leave the
entries of a box. Where the best of them lies within the radius, nothing outside the box can be
nearer or as near; where not, its distance is the next radius.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columns import given, named, quoted
from brindle.llm.scratch import Scratch

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integer components are held to this, so that distances of vectors of up to 64 components stay below 2 ** 63.
LIMIT = 1 << 27
#: Vectors whose masks are held at once.
BLOCK = 4096
#: Share of entries in a block's boxes up to which distances are taken pair by pair.
SPARSE = 1 / 32


class Slices:
    """Sorted coordinates of one part's codebook with prefix masks of entries."""

    def __init__(self, entries: np.ndarray):
        n, dims = entries.shape
        self.entries, self.words = entries, -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        bit = np.zeros((n, self.words), np.uint64)
        bit[np.arange(n), np.arange(n) >> 6] = np.uint64(1) << (np.arange(n) & 63).astype(np.uint64)
        self.prefix = np.zeros((dims, n + 1, self.words), np.uint64)
        for d in range(dims):
            np.bitwise_or.accumulate(bit[order[:, d]], axis=0, out=self.prefix[d, 1:])
        self.first = self._initial_radius()
        self.compared = self.asked = 0

    def _initial_radius(self) -> int:
        """Half the median distance from an entry to the nearest other one."""
        n = len(self.entries)
        if n < 2 or not self.entries.shape[1]:
            return 1
        least = [np.delete(np.square((self.entries - e).astype(np.float64)).sum(1), i).min() for i, e in enumerate(self.entries)]
        return max(1, int(np.sqrt(np.median(least)) / 2))

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within `radius` of x in every coordinate."""
        mask = np.full((len(x), self.words), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[d, high] ^ self.prefix[d, low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of x, ties to the lower index."""
        n = len(x)
        index, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not x.shape[1] or not n:
            return index, best
        left, radius = np.arange(n), np.full(n, self.first, np.int64)
        self.asked += n
        while len(left):
            at, distance = self._among(x[left], self.box(x[left], radius))
            index[left], best[left] = at, distance
            root = np.sqrt(np.maximum(distance, 0).astype(np.float64)).astype(np.int64) + 1
            settled = (at >= 0) & (radius >= root)
            radius = np.where(at >= 0, root, radius * 4)[~settled]
            left = left[~settled]
        return index, best

    def _among(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row's mask; -1 where the mask is empty."""
        inside = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)].view(bool)
        pairs = int(np.count_nonzero(inside))
        self.compared += pairs
        if pairs > SPARSE * inside.size and max(np.abs(x).max(), np.abs(self.entries).max()) < 1 << 20:
            # Few are excluded: one exact product of doubles, of which the masks select.
            a, b = x.astype(np.float64), self.entries.astype(np.float64)
            far = np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T)
            far[~inside] = np.inf
            index = far.argmin(1)
            distance = np.square(x - self.entries[index]).sum(1)
            return np.where(inside.any(1), index, -1), distance
        row, entry = np.nonzero(inside)
        index, distance = np.full(len(x), -1), np.zeros(len(x), np.int64)
        if len(row):
            far = np.square(x[row] - self.entries[entry]).sum(1)
            order = np.lexsort((entry, far, row))
            head = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
            index[row[head]], distance[row[head]] = entry[head], far[head]
        return index, distance


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector is null or a component is null or not finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return F.when(v.isNotNull() & finite, whole)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _parts(x: np.ndarray, books: list[Slices]) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, part, the part of those rows, nearest entries, squared distances), block by block."""
    width = x.shape[1] // len(books)
    for start in range(0, len(x), BLOCK):
        rows = slice(start, min(start + BLOCK, len(x)))
        for p, book in enumerate(books):
            own = np.ascontiguousarray(x[rows, p * width : (p + 1) * width])
            yield rows, p, own, *book.nearest(own)


def train(rows: DataFrame, key: str, column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, from rows whose `column` holds arrays of ints of one length.

    A codebook starts as that part of the rows with the `entries` least keys (null keys last, equal
    keys by vector). Each round replaces an entry by the componentwise floor of the mean of all parts
    that are nearest to it. Tasks send one sum an entry; the driver holds parts * entries of them.
    """
    start = rows.orderBy(F.col(quoted(key)).asc_nulls_last(), column).select(column).limit(entries).collect()
    dims = len(start[0][0]) if start else 0
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    width = dims // parts
    first = np.array([r[0] for r in start], np.int64).reshape(len(start), dims)
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    if not width:
        return books
    for _ in range(rounds):
        sums = rows.select(column).mapInArrow(_summing(books, dims), "cell int, n long, sums array<long>")
        total = sums.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
        for r in total.collect():
            p, e = divmod(r["cell"], len(start))
            books[p][e] = [r[f"s{d}"] // r["n"] for d in range(width)]
    return books


def _summing(books: list[np.ndarray], dims: int):
    size, width = max(map(len, books)), dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        n = np.zeros((len(books), size), np.int64)
        sums = np.zeros((len(books), size, width), np.int64)
        for batch in batches:
            for _, p, own, index, _ in _parts(_matrix(batch.column(0), dims), slices):
                n[p] += np.bincount(index, minlength=size)
                np.add.at(sums[p], index, own)
        used = np.flatnonzero(n.ravel())
        ends = np.arange(0, (len(used) + 1) * width, width, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.reshape(-1, width)[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n.ravel()[used]), lists], ["cell", "n", "sums"])

    return run


def coded(rows: DataFrame, column: str, books: list[np.ndarray]) -> DataFrame:
    """rows without `column`, with code (two hex digits for each part's index) and error (squared distances)."""
    rest = [c for c in rows.columns if c != column]
    dims = sum(b.shape[1] for b in books)
    digits = max(2, len(f"{max(max(map(len, books)) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        hexed = np.array([f"{i:0{digits}x}" for i in range(max(map(len, books)))], object)
        for batch in batches:
            x = _matrix(batch.column(column), dims)
            text, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for at, _, _, index, distance in _parts(x, slices):
                text[at] += hexed[index]
                error[at] += distance
            arrays = [batch.column(c) for c in rest] + [pa.array(text, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "code", "error"])

    kept = [f for f in rows.schema.fields if f.name != column]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vectors without `column`, with code, error, label_error (errors of equal labels summed, nulls
    together) and codebooks_sha256, which replace columns of those names.

    Rows whose vector is null or holds a null or a component that isn't finite are left out, and so
    are vectors of another length than that of the first key's. Repeated rows count each; fewer rows
    than entries give smaller codebooks; components are held to LIMIT after scaling; an empty
    table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    rest = [c for c in vectors.columns if c != column]
    whole = vectors.select(given(vectors, rest), F.col(quoted(key)).alias("k"), F.col(quoted(label)).alias("l"), integers(F.col(quoted(column))).alias("x"))
    saved = scratch.save(whole.filter("x is not null"), "rows")
    head = saved.orderBy(F.col("k").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    rows = saved.filter(F.size("x") == (head["n"] if head else 0))
    books = train(rows, "k", "x")
    found = scratch.save(coded(rows, "x", books), "coded")
    scratch.drop(saved)
    # One row a label; adaptive execution broadcasts it if it is small and splits hot labels if not.
    totals = found.groupBy("l").agg(F.sum("error").alias("label_error")).select(F.col("l").alias("m"), "label_error")
    out = found.join(totals, F.col("l").eqNullSafe(F.col("m")))
    new = ("code", "error", "label_error", "codebooks_sha256")
    return out.select(*named(rest, *new), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
