"""Near-duplicate documents by HyperMinHash signatures, banding and exact verification.

A document's set is its distinct word shingles. A signature has REGISTERS buckets; each holds
the least hash of its bucket as a count of leading zeros and a few mantissa bits, an empty bucket
borrowing from another by a fixed random walk, so that registers of two sets agree with a chance
of their Jaccard similarity. Bands of compressed registers propose candidates, the share of equal
registers corrected for chance collisions discards unlikely ones, and whole texts decide.

Equal sets are one class from the start. In a band's bucket every set is held against the
bucket's least set rather than against all others; by the triangle inequality of the Jaccard
distance, only sets that miss that pivot can have links left to find, and only with sets about as
far from the pivot as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import hashing
from brindle.llm.columns import given, named, quoted
from brindle.llm.components import components
from brindle.llm.scratch import Scratch

REGISTERS = 128
MANTISSA = 10
#: Registers in a band. 32 bands of 4 miss a pair at similarity 0.8 with a chance of 5e-8.
BAND = 4
#: Estimates are trusted from so many shingles on, and so far (over 4 standard deviations).
TRUST_FROM = 64
MARGIN = 0.2
#: Blocks of the block joins, and shingles that their matrices hold at once.
OPEN_BLOCK = 256
FULL_BLOCK = 1024
CODES = 8192
#: Parts that the members of a large family are dealt in.
SALTS = 64

_WALK = np.random.default_rng(20240101).integers(0, REGISTERS, (REGISTERS, 4096))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, text number, hash) of the distinct shingles of runs of texts, in that order."""
    for first, data, bounds in hashing.pieces(texts):
        n = len(bounds) - 1
        code, text, _ = hashing.words(data, bounds)
        count = np.bincount(text, minlength=n)
        used = np.minimum(count, width)[text]  # texts with fewer words are one shingle
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        starts = place <= count[text] - used
        at = np.flatnonzero(starts)
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            more = used[at] > k
            h[more] = hashing.mix64(h[more] * np.uint64(3) + code[at[more] + k])
        h ^= used[at].astype(np.uint64)
        h = hashing.mix64(h)
        order = np.lexsort((h, text[at]))
        t, h = text[at][order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        yield first, n, t[new], h[new]


def signatures(n: int, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Registers (n, REGISTERS) of uint16 from distinct hashes in order of text and hash."""
    bits = np.uint64(REGISTERS.bit_length() - 1)
    bucket = (h >> (np.uint64(64) - bits)).astype(np.int64)
    least = np.ones(len(h), bool)
    least[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
    value = h[least] << bits
    exact = (value >> np.uint64(11)).astype(np.float64)  # 53 bits, so that no rounding carries
    zeros = 53 - np.frexp(exact)[1]
    rest = (value << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    code = (np.minimum(zeros, 62).astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA) | rest
    out = np.zeros((n, REGISTERS), np.uint16)  # 0: empty
    out[text[least], bucket[least]] = code.astype(np.uint16)
    row, column = np.nonzero((out == 0) & (out != 0).any(axis=1)[:, None])
    own, step = out.copy(), 0
    while len(row):
        # Past the table's end the walk goes through all buckets in turn, so it always ends.
        to = _WALK[column, step] if step < _WALK.shape[1] else (column + step) % REGISTERS
        got = own[row, to]
        hit = got != 0
        out[row[hit], column[hit]] = got[hit]
        row, column, step = row[~hit], column[~hit], step + 1
    return out


def sets_of(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc_id, n, same, sig): size, 128-bit fingerprint and signature of each document's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, t, h in shingle_sets(batch.column(1), width):
                size = np.bincount(t, minlength=n)
                same = np.zeros((n, 2), np.uint64)
                np.add.at(same[:, 0], t, h)
                np.add.at(same[:, 1], t, hashing.mix64(h ^ np.uint64(0x5BD1E995)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n).cast(pa.int64()), pa.array(size, pa.int64()),
                        pa.array([r.tobytes() for r in same], pa.binary()), pa.array([r.tobytes() for r in signatures(n, t, h)], pa.binary()),
                    ],
                    ["doc_id", "n", "same", "sig"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, "doc_id long, n long, same binary, sig binary"
    )


def estimator():
    """A function of two signature columns: the share of equal registers, less what collides by chance."""

    @F.arrow_udf("double")
    def estimated(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, REGISTERS) for v in (a, b))
        chance = 2.0**-MANTISSA / 3
        return pa.array(((x == y).mean(axis=1) - chance) / (1 - chance), pa.float64())

    return estimated


def similarity(width: int):
    """A function of two text columns: shared and all shingles, from whole texts."""

    @F.arrow_udf("struct<both:long,either:long>")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        keys, sizes = [], []
        for texts in (a, b):
            size, found = np.zeros(len(texts), np.int64), []
            for first, n, t, h in shingle_sets(texts, width):
                size[first : first + n] = np.bincount(t, minlength=n)
                found.append((t + first, h))
            sizes.append(size)
            t = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.int64)
            h = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.uint64)
            keys.append((t, hashing.mix64(h + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        (t, x), (_, y) = keys
        both = np.bincount(t[np.isin(x, y)], minlength=len(a))
        return pa.StructArray.from_arrays([pa.array(both), pa.array(sizes[0] + sizes[1] - both)], ["both", "either"])

    return exact


def forest(width: int, percent: int):
    """A function of one pair of blocks, rows of (rep, label, left, text): links between left and
    other rows of different labels, as many as it takes to join what they join."""

    def work(rows: pa.Table) -> pa.Table:
        rep, label = rows["rep"].to_numpy(), rows["label"].to_numpy()
        left = rows["left"].to_numpy(zero_copy_only=False).astype(bool)
        n, parts = len(rep), [(t + first, h) for first, _, t, h in shingle_sets(rows["text"], width)]
        t, h = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        size = np.bincount(t, minlength=n)
        row, column = np.flatnonzero(left), np.flatnonzero(~left)
        place = np.empty(n, np.int64)
        place[row], place[column] = np.arange(len(row)), np.arange(len(column))
        # Counts of shared shingles, as products of 0/1 matrices over the shingles that both sides have.
        shared = np.intersect1d(h[left[t]], h[~left[t]])
        code = np.searchsorted(shared, h)
        hit = (code < len(shared)) & (shared[np.minimum(code, max(len(shared) - 1, 0))] == h if len(shared) else False)
        t, code = t[hit], code[hit]
        order = np.argsort(code, kind="stable")
        t, code = t[order], code[order]
        both = np.zeros((len(row), len(column)), np.float32)
        for start in range(0, len(shared), CODES):
            a, b = np.searchsorted(code, (start, start + CODES))
            who, what = t[a:b], code[a:b] - start
            x, y = np.zeros((len(row), CODES), np.float32), np.zeros((len(column), CODES), np.float32)
            side = left[who]
            x[place[who[side]], what[side]] = 1
            y[place[who[~side]], what[~side]] = 1
            both += x @ y.T
        either = size[row][:, None] + size[column][None] - both
        i, j = np.nonzero((both * 100 >= either * percent) & (label[row][:, None] != label[column][None]))
        root = {x: x for x in label.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for u, v in zip(row[i].tolist(), column[j].tolist(), strict=True):
            p, q = top(int(label[u])), top(int(label[v]))
            if p != q:
                root[p] = q
                found.append((rep[u], rep[v]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return work


def _bands(sig: Column) -> Column:
    return F.array(*[F.xxhash64(F.substring(sig, 2 * BAND * i + 1, 2 * BAND), F.lit(i)) for i in range(REGISTERS // BAND)])


class NearDuplicates:
    """One run over a table; percent is the least similarity that links, in hundredths."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80):
        self.docs, self.key, self.text, self.width, self.percent = docs, key, text, width, percent
        self.scratch = Scratch(docs.sparkSession, "near")

    def members(self) -> DataFrame:
        """(doc_id, n, rep): each document's set size and the least doc_id with an equal set."""
        sets = self.scratch.save(sets_of(self.docs, self.key, self.text, self.width), "sets")
        known = sets.filter("doc_id is not null and n > 0")
        reps = known.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"), F.max("n").alias("n"))
        self.reps = self.scratch.save(reps, "reps")
        own = self.reps.select("same", "rep")
        out = sets.select("doc_id", "n", "same").join(own, "same", "left")
        linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        out = self.scratch.save(out.select("doc_id", "n", F.when(linked, F.col("rep")).alias("rep")), "members")
        self.scratch.drop(sets)
        return out

    def estimates(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with the estimate j; sets too small for one get 1."""
        sig = lambda c: self.reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
        met = pairs.join(sig("a"), "a").join(sig("b"), "b")
        small = F.least("n_a", "n_b") < TRUST_FROM
        ratio = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        j = F.when(~ratio & small, F.least("n_a", "n_b") / F.greatest("n_a", "n_b")).when(small, 1.0).otherwise(estimator()("sig_a", "sig_b"))
        # A repeated doc_id can stand for several sets: a pair counts by its best.
        return met.select("a", "b", j.alias("j"), ratio.alias("ratio")).groupBy("a", "b").agg(F.max("j").alias("j"), F.max("ratio").alias("ratio"))

    def texts_of(self, reps: DataFrame) -> DataFrame:
        """(rep, text) of the documents that may link; a shuffle by id at any size, once for the whole run."""
        texts = self.docs.select(F.col(self.key).cast("long").alias("rep"), F.col(self.text).alias("text"))
        return self.scratch.save(texts.join(reps.distinct().hint("merge"), "rep", "left_semi").distinct(), "texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with `linked`, whether their whole texts link."""
        side = lambda c: self.texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
        met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        seen = met.select("a", "b", similarity(self.width)("text_a", "text_b").alias("s"))
        linked = F.max(F.col("s.both") * 100 >= F.col("s.either") * self.percent).alias("linked")
        return self.scratch.save(seen.groupBy("a", "b").agg(linked), "verified")

    def run(self) -> DataFrame:
        """(doc_id, n, component) of every document."""
        members = self.members()
        rows = self.reps.select("rep", F.explode(_bands(F.col("sig"))).alias("band"))
        pivots = rows.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
        stars = self.scratch.save(rows.join(pivots, "band").filter("rep != pivot"), "stars")
        likely = self.percent / 100 - MARGIN
        tried = self.scratch.save(self.estimates(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()), "tried")
        self.texts = self.texts_of(tried.select(F.explode(F.array("a", "b")).alias("rep")))
        verified = self.verified(tried.filter(F.col("ratio") & (F.col("j") >= likely)))
        links = verified.filter("linked").select("a", "b")
        # One doc_id on several rows may have several sets; they are one node.
        several = members.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a != b")
        same = members.join(several.select("doc_id", "a"), "doc_id").filter("rep != a").select("a", F.col("rep").alias("b"))
        links = links.unionByName(same)
        parts = components(links, self.scratch)
        rest = self.rest(stars, tried.join(verified, ["a", "b"], "left"), parts)
        if rest is not None:
            if not rest.isEmpty():
                parts = components(links.unionByName(rest), self.scratch)
        met = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        own = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
        return met.select("doc_id", "n", own.alias("component"))

    def rest(self, stars: DataFrame, tried: DataFrame, parts: DataFrame) -> DataFrame | None:
        """Links that the pivots left open.

        Sets that miss their pivot by little are held against the pivot's whole component and each
        other; sets that miss it by far, against the others of their bucket that miss it. What lies
        between is ruled out by distance. Both are block joins: a task gets two blocks of whole
        texts and returns a spanning forest of their links, so nothing grows with pairs. A pair too
        small for an estimate counts as close and, if its texts don't link, as far too.
        """
        label = parts.withColumnRenamed("node", "rep").withColumnRenamed("component", "label")
        to_pivot = parts.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_label"))
        known = stars.filter("size > 2").join(tried.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "j", "linked"), ["rep", "pivot"])
        placed = known.join(label, "rep", "left").join(to_pivot, "pivot", "left").select(
            "band", "rep", "pivot", "j", "linked", F.coalesce("label", "rep").alias("label"), F.coalesce("pivot_label", "pivot").alias("pivot_label")
        )
        placed = self.scratch.save(placed, "placed")
        least = self.percent / 100
        close = F.col("j") >= least - (1 - least) - MARGIN
        missing = placed.filter("label != pivot_label")
        near = missing.filter(close).select(F.col("pivot_label").alias("family"), "rep", "label").distinct()
        own = placed.filter("label = pivot_label").select(F.col("pivot_label").alias("family"), "rep", "label")
        own = own.unionByName(placed.select(F.col("pivot_label").alias("family"), F.col("pivot").alias("rep"), F.col("pivot_label").alias("label"))).distinct()
        own = own.join(near.select("family").distinct(), "family", "left_semi")
        members = near.withColumn("open", F.lit(True)).unionByName(own.withColumn("open", F.lit(False)))
        # The same for buckets in which several components miss the pivot.
        loose = placed.filter((F.col("j") < least + MARGIN / 2) | ~F.col("linked")).select(F.col("band").alias("family"), "rep", "label", (~close & (F.col("label") != F.col("pivot_label"))).alias("open"))
        mixed = loose.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("open").alias("o")).filter("x != y and o").select("family")
        members = members.unionByName(loose.join(mixed, "family", "left_semi"))
        members = self.scratch.save(members, "families")
        if members.isEmpty():
            return None
        sizes = members.groupBy("family").agg(
            F.ceil(F.sum(F.col("open").cast("int")) / OPEN_BLOCK).alias("rows"), F.ceil(F.count("*") / FULL_BLOCK).alias("columns")
        )
        # Few families have more than a block. Their members may be most of all rows, so they meet the sizes in parts.
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt")
        large = sizes.filter("rows > 1 or columns > 1").select("*", salt)
        dealt = members.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(SALTS))).join(large, ["family", "salt"], "left")
        dealt = dealt.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rows", "columns")})
        at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
        other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1).cast("array<bigint>"))
        left = dealt.filter("open").select("family", at("rows").alias("r"), other("columns").alias("c"), "rep", "label", F.lit(True).alias("left"))
        right = dealt.select("family", other("rows").alias("r"), at("columns").alias("c"), "rep", "label", F.lit(False).alias("left"))
        blocks = left.unionByName(right).join(self.texts, "rep")
        found = blocks.groupBy("family", "r", "c").applyInArrow(forest(self.width, self.percent), "a long, b long")
        links = self.scratch.save(found.distinct(), "rest")
        self.scratch.drop(placed, members)
        return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    Texts without words, null ones too, have an empty set and link with nothing. A row whose
    doc_id is null takes no part: it is kept, with a null component. Rows that share a doc_id are
    one node. component_id is the least doc_id reachable by links, kept says that it is the row's own.
    An empty table gives an empty result; other columns are not read.
    """
    out = NearDuplicates(docs, key, text, width, percent).run()
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, and one row of each doc_id that repeats.

    Rows without a doc_id all stay; columns keep their names and values, whatever they are; an empty
    table gives an empty result.
    """
    verdict = near_duplicates(docs, key, text, width, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(given(docs), F.col(quoted(key)).cast("long").alias("doc_id"))
    one = rows.join(verdict, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("given", F.xxhash64("given")).alias("given"))
    return one.select(*named(docs.columns)).unionByName(docs.filter(F.col(key).isNull()))
