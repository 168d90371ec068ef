"""Importance resampling towards a target text collection, by hashed n-gram buckets.

Each Arrow batch makes a dictionary of its distinct words, bounded by delimiters on both sides, as
an Aho-Corasick automaton whose payloads stand for a word's CRC and byte length. One scan of a text
emits its words' payloads in order; the CRC of a run of words is composed from adjacent payloads
without looking at their bytes again, and modulo the number of buckets it is the run's bucket. A
text leaves its task as (bucket, count) pairs, which are counted for the corpus and scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import hashing
from brindle.llm.columns import given, named, quoted
from brindle.llm.scratch import Scratch

#: Lower-cases A-Z; every ASCII character but letters and digits is a delimiter.
_FOLD = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_POLYNOMIAL = np.uint32(0xEDB88320)  # fixed value: CRC-32, bits reversed


def _advanced() -> np.ndarray:
    """tables[k, j, v]: what byte j of value v of a CRC becomes when 2 ** k zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & np.uint32(1), (one >> np.uint32(1)) ^ _POLYNOMIAL, one >> np.uint32(1))
    value = np.arange(256, dtype=np.uint32)
    step = np.stack([one[value], value, value << np.uint32(8), value << np.uint32(16)])
    tables = [step]
    for _ in range(31):
        step = _apply(step, step)
        tables.append(step)
    return np.stack(tables)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for j in range(4):
        out ^= tables[j][(crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


_ZEROS = _advanced()
_SPACE = np.uint32(zlib.crc32(b" "))


def followed(crc: np.ndarray, other: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """CRC-32 of joined strings from those of the first and the second and the second's length in bytes."""
    size = np.broadcast_to(np.asarray(size, np.int64), crc.shape)
    out = crc.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        more = (size >> k) & 1 == 1
        out[more] = _apply(_ZEROS[k], out[more])
    return out ^ other


def scan(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of its first text, words of each text, CRC and byte length of each word in order) of runs of texts."""
    for first, data, bounds in hashing.pieces(texts):
        folded = data.tobytes().translate(_FOLD)
        runs = [folded[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        distinct = sorted({w for run in runs for w in run.split()})
        crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        automaton = ahocorasick.Automaton()
        for n, word in enumerate(distinct):
            automaton.add_word(f" {word.decode()} ", n)
        found = [[]] * len(runs)
        if distinct:
            automaton.make_automaton()
            found = [[n for _, n in automaton.iter(f" {run.decode()} ")] for run in runs]
        words = np.fromiter(map(len, found), np.int64, len(found))
        payload = np.fromiter((n for f in found for n in f), np.int64, int(words.sum()))
        yield first, words, crc[payload], size[payload]


def bucketed(texts: pa.Array, n_words: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words of each text, then sorted by text: text number, bucket, count) of all runs of 1 to n_words words."""
    for first, words, crc, size in scan(texts):
        text = np.repeat(np.arange(len(words)), words)
        run, keys = crc, [text * buckets + crc.astype(np.int64) % buckets]
        for k in range(1, n_words):
            if len(crc) <= k:
                break
            run = followed(followed(run[:-1], _SPACE, 1), crc[k:], size[k:])
            inside = text[:-k] == text[k:]
            keys.append((text[:-k] * buckets + run.astype(np.int64) % buckets)[inside])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        yield first, words, key // buckets, key % buckets, count


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def features(docs: DataFrame, text: str = "_text", n_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """docs without `text`, with _words (long) and the distinct _buckets and their _counts (arrays of ints)."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, at, bucket, count in bucketed(batch.column(text), n_words, buckets):
                ends = np.searchsorted(at, np.arange(len(words) + 1))
                own = batch.slice(first, len(words))
                arrays = [*[own.column(c) for c in rest], pa.array(words), _lists(ends, bucket), _lists(ends, count)]
                yield pa.RecordBatch.from_arrays(arrays, [*rest, "_words", "_buckets", "_counts"])

    ints = T.ArrayType(T.IntegerType())
    new = [T.StructField("_words", T.LongType()), T.StructField("_buckets", ints), T.StructField("_counts", ints)]
    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != text] + new))


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(total, at, n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = found.select("_buckets", "_counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of a bucket's smoothed shares in target and corpus)."""
    n, t_all, s_all = len(target), float(target.sum()), float(corpus.sum())
    ratio = lambda t, s: (float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(t, s))) for t, s in zip(target, corpus, strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found without its arrays, with _features and _weight, the floored mean gain of a text's features."""
    rest = [c for c in found.columns if c not in ("_buckets", "_counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("_buckets"), batch.column("_counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            total, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            np.add.at(total, text, n)
            np.add.at(value, text, n * gain[at.flatten().to_numpy(zero_copy_only=False)])
            weight = value // np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(total), pa.array(weight)], [*rest, "_features", "_weight"])

    new = [T.StructField("_features", T.LongType()), T.StructField("_weight", T.LongType())]
    return found.mapInArrow(run, T.StructType([f for f in found.schema.fields if f.name in rest] + new))


def noise(key: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel number) that seed and key determine; a null key reads as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_words: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """docs without `text`, with n_features, weight, score and rank (null if undrawn), which replace
    columns of those names.

    Of the N documents with `least_words` words or more, floor(percent * N / 100) are drawn by highest
    score, which is a sample without replacement by importance weights; ties go to the smaller key,
    null keys last. Null and empty texts have no features and weight 0. Repeated rows count and are
    drawn each. An empty target gives all documents weights by the corpus alone; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(given(docs, rest), F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    found = scratch.save(features(packed, "_text", n_words, buckets), "features")
    wanted = histogram(features(target.select(F.col(quoted(text)).alias("_text")), "_text", n_words, buckets), buckets)
    rows = weighed(found, gains(wanted, histogram(found, buckets)))
    scored = scratch.save(rows.withColumn("_score", F.col("_weight") + noise(F.col("_key"), seed)), "scored")
    scratch.drop(found)
    # Scores are integers between bounds that logarithms of counts set, about 100,000 in all, so that
    # the table of how many documents have each score is small at every size.
    fit = F.col("_words") >= least_words
    counts = sorted(((r[0], r[1]) for r in scored.filter(fit).groupBy("_score").count().collect()), reverse=True)
    draws, above, before = sum(n for _, n in counts) * percent // 100, 0, []
    for score, n in counts:
        if above >= draws:
            break
        before.append((score, above))
        above += n
    cut = before[-1][0] if before else None
    drawn = fit & (F.col("_score") >= F.lit(cut)) if before else F.lit(False)
    place = F.row_number().over(Window.partitionBy("_score").orderBy(F.col("_key").asc_nulls_last(), "_weight", "_features"))
    first = docs.sparkSession.createDataFrame(before, "_score long, _above long")
    ranked = scored.filter(drawn).join(F.broadcast(first), "_score").withColumn("_rank", F.col("_above") + place)
    ranked = ranked.withColumn("_rank", F.when(F.col("_rank") <= draws, F.col("_rank")))
    out = ranked.drop("_above").unionByName(scored.filter(~F.coalesce(drawn, F.lit(False))).withColumn("_rank", F.lit(None).cast("long")))
    new = {"n_features": "_features", "weight": "_weight", "score": "_score", "rank": "_rank"}
    return out.select(*named(rest, *new), *[F.col(c).cast("long").alias(n) for n, c in new.items()])
