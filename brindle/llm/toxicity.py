"""Toxicity by class-conditional Kneser-Ney language models.

A bigram model is fitted to toxic and another to ordinary labelled documents. Both discount what
they have seen and give the rest to continuation counts of their own class and to counts that the
classes share: of words over the whole corpus, labelled or not, and of word pairs over both
classes, so that an expression too rare to tell the classes apart says little. A text is compared
by its length-normalised log-likelihood ratio, over the whole text and over its most telling
words; a logistic curve, fitted to labelled documents that the models haven't seen, makes these
ratios a score.

The classifier learns from a seeded choice of about DOCS_A_CLASS labelled documents and
BYTES_A_CLASS bytes of each class at most. That bounds what is broadcast; nothing that was learnt
from the choice is left out. Shared word counts are over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import hashing
from brindle.llm.columns import given, named
from brindle.llm.scratch import Scratch

#: Bounds on the labelled documents of a class that models and curve are fitted to, and on their bytes.
DOCS_A_CLASS = 6_000
BYTES_A_CLASS = 24_000_000
DISCOUNT = 0.75
#: So many of a text's most toxic words are compared by themselves, beside the whole text.
TELLING = (1, 3)
FEATURES = len(TELLING) + 2
FOLDS = 5
SEED = 29


def held_out(key: Column) -> Column:
    """Whether labels of this document are kept from learning; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _bigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text number) of every word; a text's first word has context 0."""
    code, text, _ = hashing.words(data, bounds, hashing.BREAKS)
    context = np.zeros_like(code)
    context[1:] = np.where(text[1:] == text[:-1], code[:-1], np.uint64(0))
    return context, code, text


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return hashing.mix64(context * np.uint64(3) + word)


def chosen_labels(rows: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", label: str = "toxic") -> tuple[DataFrame, float]:
    """((doc_id, toxic, part), odds): the seeded choice and the log odds of the classes among all learnable
    labels. Two thirds (part 0 and 1) are for the models, the rest for the curve."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("doc_id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("toxic"))
    sizes = known.join(rows.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")
    counts = {r["toxic"]: r for r in sizes.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    share = {c: min(1.0, DOCS_A_CLASS / r["n"], BYTES_A_CLASS / max(r["bytes"] or 0, 1)) for c, r in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(3)).alias("part")
    taken = known.filter(draw < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    n = [counts[c]["n"] if c in counts else 0 for c in (0, 1)]
    return scratch.save(taken.select("doc_id", "toxic", part), "chosen"), float(np.log((n[1] + 1) / (n[0] + 1)))


def bigram_counts(texts: DataFrame) -> DataFrame:
    """(u, v, n0, n1) over rows of (toxic, text): documents of each class that have a bigram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("u", np.uint64), ("v", np.uint64), ("t", np.int64)])
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, bounds in hashing.pieces(batch.column(1)):
                u, v, text = _bigrams(data, bounds)
                rows = np.empty(len(u), kind)
                rows["u"], rows["v"], rows["t"] = u, v, text
                rows = np.unique(rows)  # a text counts a bigram once, however often it repeats it
                pairs, place = np.unique(rows[["u", "v"]], return_inverse=True)
                n = [np.bincount(place[toxic[first + rows["t"]] == c], minlength=len(pairs)) for c in (0, 1)]
                u, v = (np.ascontiguousarray(pairs[c]).view(np.int64) for c in "uv")
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n[0]), pa.array(n[1])], ["u", "v", "n0", "n1"])

    counts = texts.select("toxic", "text").mapInArrow(work, "u long, v long, n0 long, n1 long")
    return counts.groupBy("u", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def corpus_counts(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(v, docs): how many documents of the whole corpus have each word of the vocabulary (sorted hashes,
    as many as the chosen documents have). A task sums over all its documents before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, data, bounds in hashing.pieces(batch.column(0)):
                code, text, _ = hashing.words(data, bounds, hashing.BREAKS)
                place = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                hit = known[place] == code if len(known) else np.zeros(len(code), bool)
                once = np.unique(place[hit] + text[hit] * len(known)) % max(len(known), 1)
                total += np.bincount(once, minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(total[at])], ["v", "docs"])

    return rows.select("text").mapInArrow(work, "v long, docs long").groupBy("v").agg(F.sum("docs").alias("docs"))


def log_ratios(counts: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Log of toxic over ordinary probability: of bigrams (u, v, r), of the backoff weight after a
    context (u, r), and of a word after backing off (v, r); and of a word that neither class has.

    Shared word counts enter by their logarithm: they are for rare words, common ones rest on their own class."""
    d, both = DISCOUNT, (0, 1)
    seen = lambda c: F.count_if(F.col(f"n{c}") > 0).cast("double").alias(f"t{c}")
    context = counts.groupBy("u").agg(*[F.sum(f"n{c}").cast("double").alias(f"c{c}") for c in both], *[seen(c) for c in both])
    word = counts.groupBy("v").agg(*[seen(c) for c in both]).join(corpus, "v", "left").withColumn("docs", F.log1p(F.coalesce("docs", F.lit(0)).cast("double")) + 1.0)
    total = word.agg(F.sum("docs").alias("docs"), *[F.sum(f"t{c}").alias(f"t{c}") for c in both], *[F.count_if(F.col(f"t{c}") > 0).alias(f"w{c}") for c in both]).first()
    types = {c: max(total[f"t{c}"] or 0.0, 1.0) for c in both}
    free = {c: max(d * (total[f"w{c}"] or 0) / types[c], 1e-3) for c in both}
    shared = F.col("docs") / ((total["docs"] or 0.0) + 1)
    p_word = lambda c: F.greatest(F.col(f"t{c}") - d, F.lit(0.0)) / types[c] + free[c] * shared
    word = word.select("v", *[p_word(c).alias(f"p{c}") for c in both])
    weight = lambda c: F.when(F.col(f"c{c}") > 0, d * F.col(f"t{c}") / F.col(f"c{c}")).otherwise(1.0)
    context = context.select("u", "c0", "c1", *[weight(c).alias(f"b{c}") for c in both])
    own = lambda c: F.when(F.col(f"c{c}") > 0, F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.col(f"c{c}")).otherwise(0.0)
    together = (F.col("n0") + F.col("n1")) / (F.col("c0") + F.col("c1"))
    p_pair = lambda c: own(c) + F.col(f"b{c}") * (together + F.col(f"p{c}")) / 2
    pair = counts.join(context, "u").join(word, "v")
    return (
        pair.select("u", "v", F.log(p_pair(1) / p_pair(0)).alias("r")),
        context.select("u", F.log(F.col("b1") / F.col("b0")).alias("r")),
        word.select("v", F.log(F.col("p1") / F.col("p0")).alias("r")),
        float(np.log(free[1] / free[0])),
    )


class _Table:
    """Sorted keys and values, with a bitmap in front that turns most absent keys away."""

    BITS = 22

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.may = np.zeros(1 << self.BITS, bool)
        self.may[keys >> np.uint64(64 - self.BITS)] = True

    def get(self, wanted: np.ndarray, otherwise: float) -> np.ndarray:
        out = np.full(len(wanted), otherwise, np.float32)
        at = np.flatnonzero(self.may[wanted >> np.uint64(64 - self.BITS)])
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, wanted[at]), len(self.keys) - 1)
            hit = self.keys[place] == wanted[at]
            out[at[hit]] = self.values[place[hit]]
        return out


def collected(ratios: DataFrame, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their ratios: 12 bytes for each bigram or word of the chosen documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(len(keys))]
            key = _joined(*columns) if len(keys) == 2 else columns[0]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(len(keys)).cast(pa.float32())], ["k", "r"])

    rows = ratios.select(*keys, "r").mapInArrow(work, "k long, r float").toArrow()
    key, r = rows["k"].to_numpy().view(np.uint64), rows["r"].to_numpy()
    order = np.argsort(key)
    return key[order], r[order]


def features(texts: pa.Array, model: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, features) of runs of texts: the mean ratio of a word over the whole text and the
    means over its TELLING most toxic words, and the logarithm of the length. Without words, zeros."""
    pairs, contexts, words, unknown = model
    for first, data, bounds in hashing.pieces(texts):
        u, v, text = _bigrams(data, bounds)
        n = len(bounds) - 1
        r = pairs.get(_joined(u, v), np.nan)
        new = np.isnan(r)
        r[new] = contexts.get(u[new], 0.0) + words.get(v[new], unknown)
        size = np.bincount(text, minlength=n)
        out = np.zeros((n, FEATURES))
        out[:, 0] = np.bincount(text, weights=r, minlength=n) / np.maximum(size, 1)
        order = np.lexsort((-r, text))
        place = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        for i, most in enumerate(TELLING, 1):
            top = order[place < most]
            out[:, i] = np.bincount(text[top], weights=r[top], minlength=n) / np.maximum(np.minimum(size, most), 1)
        out[:, -1] = np.log1p(size)
        yield first, out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's steps on scaled features: (mean, scale, weights with the intercept last)."""
    k = FEATURES
    if not len(x):
        return np.zeros(k), np.ones(k), np.zeros(k + 1)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - 0.01 * len(x) ** 0.5 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * len(x) ** 0.5 * np.eye(k + 1)
        w = w + np.linalg.solve(bend, slope)
    return mean, scale, w


class Model:
    """What scoring needs: the broadcast tables of ratios and the curve. close() frees the tables."""

    def __init__(self, shared, curve: tuple | None):
        self.shared, self.curve = shared, curve

    def close(self) -> None:
        self.shared.destroy()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The models and the curve, from labelled documents whose held_out is false.

    Labels that are null, or of no document, teach nothing; any label above 0 counts as toxic. A
    document with several labels is toxic if one says so. Null texts count as empty. With no labels,
    or an empty table, every text gets one score.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxic")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen, odds = chosen_labels(rows, labels, scratch)
    # chosen has about 2 * DOCS_A_CLASS rows at most.
    texts = scratch.save(rows.join(F.broadcast(chosen), "doc_id").select("toxic", "part", "text"), "texts")
    counts = scratch.save(bigram_counts(texts.filter("part < 2")), "counts")
    vocabulary = np.sort(counts.select("v").distinct().toArrow()["v"].to_numpy().view(np.uint64))
    corpus = scratch.save(corpus_counts(rows, vocabulary), "corpus")
    pairs, contexts, words, unknown = log_ratios(counts, corpus)
    tables = [collected(pairs, "u", "v"), collected(contexts, "u"), collected(words, "v")]
    shared = spark.sparkContext.broadcast((tables, unknown))
    del tables, vocabulary
    model = Model(shared, None)
    seen = _with_features(texts.filter("part = 2"), ["toxic"], F.col("text"), model).toPandas()
    x = np.array(seen["f"].tolist()).reshape(-1, FEATURES)
    y = seen["toxic"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # a fixed order, so that reruns agree
    mean, scale, w = fit_curve(x[order], y[order])
    # The curve knows the classes as often as they were chosen; scores are to know them as often as they are.
    w[-1] += odds - float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model.curve = (mean, scale, w)
    scratch.drop(texts, counts, corpus, chosen)
    return model


def _with_features(rows: DataFrame, keep: list, text: Column, model: Model) -> DataFrame:
    shared = model.shared
    built: list[tuple] = []  # once a task

    @F.arrow_udf("array<double>")
    def work(texts: pa.Array) -> pa.Array:
        if not built:
            arrays, rest = shared.value
            built.append((*(_Table(k, v) for k, v in arrays), rest))
        parts = [f for _, f in features(texts, built[0])]
        flat = np.concatenate(parts) if parts else np.empty((0, FEATURES))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, FEATURES * len(flat) + 1, FEATURES), pa.int32()), pa.array(flat.ravel()))

    return rows.select(*keep, work(text).alias("f"))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, unless given) with score and predicted, which
    replace columns of those names.

    Null and empty texts get the score of a text without words. Each row is scored by its text
    alone, repeated rows alike; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    mean, scale, w = model.curve
    out = _with_features(docs, [given(docs, keep)], F.col(text), model)
    z = F.lit(float(w[-1]))
    for i in range(FEATURES):
        z = z + (F.get("f", F.lit(i)) - float(mean[i])) / float(scale[i]) * float(w[i])
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return out.select("given", score.alias("score")).select(*named(keep, "score", "predicted"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
