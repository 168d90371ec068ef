"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good, votes bad or abstains. How often
each pattern of votes occurs is counted over all documents; expectation-maximisation on those
counts (at most 3 ** rules of them, whatever the number of documents) estimates how often each
rule votes bad on bad and on good documents. A document's posterior is then a sum of per-vote
log odds, so scoring is one narrow projection without joins or shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.columns import given, named
from brindle.llm.scratch import Scratch

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_POSTERIOR = 0.1


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def window_hashes(hashes: str, width: int = WINDOW) -> Column:
    """A hash of each run of `width` items of the array column `hashes`, in order."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(width))))
    return F.when(n >= width, runs).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: str, width: int = WINDOW) -> Column:
    """Number of words inside windows that occur twice or more, from the column of window hashes."""
    wins = F.col(windows)
    # A hash's high bits and its position in one long: primitive arrays sort fast. Neighbours
    # in that order count as the same window only if their whole hashes are equal.
    low = F.when(F.size(wins) < 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("bigint")
    packed = F.sort_array(F.transform(wins, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))))

    def starts(ranked: Column) -> Column:
        hash_at = lambda j: F.get(wins, F.get(ranked, j).bitwiseAND(low).cast("int"))
        same = lambda x, j: F.coalesce(hash_at(j) == F.get(wins, x.bitwiseAND(low).cast("int")), F.lit(False))
        twice = F.filter(ranked, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low).cast("int")))

    def covered(firsts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct(
            (acc["n"] + p + width - F.greatest(p, acc["end"])).alias("n"), (p + width).alias("end")
        )
        return F.aggregate(firsts, zero, step, lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(
        let(packed, lambda ranked: let(starts(ranked), covered))
    )


def with_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """(given, _q): the columns `keep` of docs (all, unless named) packed in a struct, beside one of
    whole-text statistics (null text: as empty)."""
    body = F.col("_body")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.select(given(docs, keep), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    staged = staged.withColumn("_w", word_array(body)).withColumn("_l", lines)
    staged = staged.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_joined", F.array_join("_w", ""))
    return staged.withColumn("_wins", window_hashes("_h")).select(
        "given",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length("_joined").cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            repeated_words("_wins").cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.length(F.regexp_replace("_joined", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace("_joined", r"[^0-9]+", "")).cast("long").alias("n_digits"),
            F.length(F.regexp_replace("_joined", r"\p{L}+", "")).cast("long").alias("n_other"),
        ).alias("_q"),
    )


def rule_votes(q: str = "_q") -> list[tuple[str, Column]]:
    """(name, vote) of each rule: 1 good, -1 bad, 0 abstains."""
    s = lambda c: F.col(f"{q}.{c}").cast("double")
    n = F.greatest(s("n_words"), F.lit(1.0))

    def vote(value: Column, bad: float, good: float) -> Column:
        """Bad from `bad` up, good up to `good`, between them an abstention."""
        return F.when(value >= bad, -1).when(value <= good, 1).otherwise(0)

    mean = s("word_chars") / n
    return [
        ("length", F.when(s("n_words") < MIN_WORDS, -1).when(s("n_words") >= 40, 1).otherwise(0)),
        ("word_length", F.when((mean < 2.5) | (mean > 14), -1).when(mean.between(3.5, 9.5), 1).otherwise(0)),
        ("symbols", vote(s("n_symbols") / n, 0.25, 0.05)),
        ("repeated_lines", vote(s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1.0)), 0.3, 0.1)),
        ("repeated_words", vote(s("n_repeat_words") / n, 0.3, 0.1)),
        ("capitals", vote(s("n_upper") / F.greatest(s("word_chars"), F.lit(1.0)), 0.4, 0.15)),
        ("letters", vote(s("n_other") / F.greatest(s("word_chars"), F.lit(1.0)), 0.13, 0.08)),
        ("digits", vote(s("n_digits") / F.greatest(s("word_chars"), F.lit(1.0)), 0.3, 0.1)),
    ]


def fit_reliabilities(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 30) -> dict:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the prior log odds of good and, for each rule, the log odds that a bad and a good
    vote add. Rates stay inside (0.001, 0.999), and a rule's bad votes never count for good.
    """
    width = len(rule_votes())
    clip = lambda x: min(0.999, max(0.001, x))
    prior, on_bad, on_good = 0.9, [0.5] * width, [0.02] * width
    for _ in range(rounds):
        weights = _odds(prior, on_bad, on_good)
        good = bad = 0.0
        seen = [[1.0, 2.0, 0.1, 2.0] for _ in range(width)]  # votes on bad: bad, all; on good: bad, all
        for votes, count in patterns:
            p = posterior(votes, weights)
            good, bad = good + p * count, bad + (1 - p) * count
            for j, v in enumerate(votes):
                if v:
                    seen[j][0] += (1 - p) * count * (v < 0)
                    seen[j][1] += (1 - p) * count
                    seen[j][2] += p * count * (v < 0)
                    seen[j][3] += p * count
        prior = min(0.99, max(0.5, (good + 1) / (good + bad + 2)))
        on_good = [clip(x[2] / x[3]) for x in seen]
        on_bad = [max(clip(x[0] / x[1]), g) for x, g in zip(seen, on_good, strict=True)]
    return _odds(prior, on_bad, on_good)


def _odds(prior: float, on_bad: list[float], on_good: list[float]) -> dict:
    return {
        "prior": math.log(prior / (1 - prior)),
        "rules": [(math.log(g / b), math.log((1 - g) / (1 - b))) for b, g in zip(on_bad, on_good, strict=True)],
    }


def posterior(votes: Sequence[int], weights: dict) -> float:
    z = weights["prior"] + sum((w[0] if v < 0 else w[1]) for v, w in zip(votes, weights["rules"], strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def vote_counts(stats: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Counts of vote patterns over all rows: at most 3 ** rules rows reach the driver."""
    votes = [v.cast("int").alias(f"v{i}") for i, (_, v) in enumerate(rule_votes())]
    names = [f"v{i}" for i in range(len(votes))]
    rows = stats.select(*votes).groupBy(*names).count().collect()
    return sorted((tuple(r[c] for c in names), r["count"]) for r in rows)


def with_posterior(stats: DataFrame, weights: dict) -> DataFrame:
    """Adds p_good, base_failed and kept to rows that carry `_q`."""
    z = F.lit(weights["prior"])
    for (_, v), (bad, good) in zip(rule_votes(), weights["rules"], strict=True):
        z = z + F.when(v < 0, F.lit(bad)).when(v > 0, F.lit(good)).otherwise(F.lit(0.0))
    failed = (F.col("_q.n_words") < MIN_WORDS) | (
        100 * F.col("_q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q.n_words")
    )
    out = stats.withColumn("p_good", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= MIN_POSTERIOR))


def _judged(docs: DataFrame, text: str, keep: Sequence[str] | None = None) -> DataFrame:
    stats = Scratch(docs.sparkSession, "quality").save(with_statistics(docs, text, keep), "stats")
    return with_posterior(stats, fit_reliabilities(vote_counts(stats)))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_q`, p_good, base_failed and kept, which replace columns of those names.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike,
    other columns pass through, whatever their names, an empty table gives an empty result. Texts
    are read once: the statistics are written beside the columns of docs, so give only those that
    are needed.
    """
    new = ("_q", "p_good", "base_failed", "kept")
    return _judged(docs, text).select(*named(docs.columns, *new), *new)


def judge_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As judge(), with only the key beside the verdicts."""
    return _judged(docs, text, [key]).select(F.col(f"given.{key}").alias(key), "_q", "p_good", "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with the columns they came with, whatever their names."""
    return _judged(docs, text).filter("kept").select(*named(docs.columns))
