"""Mixing sources to target weights by subset-sum fitting of word budgets.

Sizes are counted once a document. A source takes all of its documents as often as its target
holds them whole, and for what remains a subset: documents are counted by exact length, and a
bounded-knapsack table picks how many of each length to add, over the whole budget or over what
is left of a large one after all lengths gave the same share. Which documents of a length go in follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.columns import given, named
from brindle.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MOST_TIMES = 2
SEED = 17
#: Budgets that the table can't hold whole are drawn down to this many words or to the next document's length.
TABLE_WORDS = 1 << 17
#: Bits of all steps of a table that holds a budget whole (32 MB).
TABLE_BITS = 1 << 28
#: Least number of parts that the documents of one source and length are ranked in, by hash, and documents
#: for each further part: all documents may be of one source and length.
PARTS, PART_ROWS = 64, 1_000_000


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, percent: int = TOTAL_PERCENT) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in order of code points, null last, have the weights in turn. A target is the weight
    times a common level, or MOST_TIMES the source's size where that is less; the level is found by
    resharing what the full sources leave, round by round, and only sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.lit(list(map(float, weights))), (turn + 1).cast("int"))
    table = Scratch(sizes.sparkSession, "mix").save(
        totals.select("source", "source_size", weight.alias("w"), (MOST_TIMES * F.col("source_size")).alias("most")), "sources"
    )
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    budget = budget * percent / 100
    level = 0.0
    while True:
        full = F.col("most") <= F.col("w") * level
        r = table.agg(F.sum(F.when(full, F.col("most"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not r["w"]:
            break
        higher = (budget - (r["full"] or 0)) / r["w"]
        if higher <= level:
            break
        level = higher
    return table.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("w") * level).alias("target"))


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come nearest to `budget`.

    A table of reachable sums, one bit a word, fits the budget exactly where its steps take at most
    TABLE_BITS. Otherwise every length first gives the same share of all but the table's part,
    rounded down, long documents draw the leftover down, and the table fits the rest. Where
    every document that is left is far longer than the leftover, the nearest of one more or none
    is taken, and one that exceeds the budget is weighed against dropping others for it.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if sum(int(c).bit_length() for c in counts) * (2 * budget + 1) <= TABLE_BITS:
        return _fitted(lengths, counts, [0] * len(lengths), budget)
    taken = _drawn(lengths, counts, budget)
    left = budget - _sum(lengths, taken)
    if left <= 2 * TABLE_WORDS:
        return _fitted(lengths, counts, taken, left)
    # Each document left is longer than left - TABLE_WORDS / 2, so two miss by more than one or none.
    choices, spare = [taken], [i for i, n in enumerate(lengths) if n > 0 and taken[i] < counts[i]]
    near = sorted(spare, key=lambda i: abs(lengths[i] - left))[:1] + sorted((i for i in spare if lengths[i] > left), key=lambda i: lengths[i])[:1]
    for i in near:
        more = [t + (j == i) for j, t in enumerate(taken)]
        choices.append(more)
        over = _sum(lengths, more) - budget
        if over > 0:
            out = _drawn(lengths, more, over)
            rest = over - _sum(lengths, out)
            if rest <= 2 * TABLE_WORDS:
                out = _fitted(lengths, more, out, rest)
            choices.append([m - o for m, o in zip(more, out, strict=True)])
    return min(choices, key=lambda c: abs(_sum(lengths, c) - budget))


def _sum(lengths: Sequence[int], taken: Sequence[int]) -> int:
    return sum(n * t for n, t in zip(lengths, taken, strict=True))


def _drawn(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """Counts whose words leave up to TABLE_WORDS of the budget, or as little as documents that fit allow."""
    total = _sum(lengths, counts)
    spread = max(0, budget - TABLE_WORDS // 2)  # what stays gives the table documents to choose from
    taken = [c * spread // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - _sum(lengths, taken)
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    while left > TABLE_WORDS:
        before = left
        for i in order:  # one of each length at most in a round
            if taken[i] < counts[i] and lengths[i] <= left - TABLE_WORDS // 2:
                taken[i] += 1
                left -= lengths[i]
        if left == before:
            break
    return taken


def _fitted(lengths: Sequence[int], counts: Sequence[int], taken: Sequence[int], left: int) -> list[int]:
    """`taken` with more documents whose words come nearest to `left`, by a table of reachable sums with
    counts split into powers of two. Sums beyond twice `left` are further off than no document."""
    taken, span = list(taken), 2 * left + 1
    mask, reach, steps = (1 << span) - 1, 1, []
    for i in sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: lengths[i]):  # short ones first: few steps reach most sums
        spare, part = counts[i] - taken[i], 1
        while spare > 0 and lengths[i] * part < span:
            k = min(part, spare)
            new = (reach | reach << (lengths[i] * k)) & mask
            if new != reach:
                steps.append((i, k, reach))
                reach = new
            spare, part = spare - k, part * 2
        if reach >> left & 1:
            break
    goal, above = (reach & ((2 << left) - 1)).bit_length() - 1, reach >> left
    if above:
        higher = left + (above & -above).bit_length() - 1
        goal = goal if left - goal <= higher - left else higher
    for i, k, before in reversed(steps):
        if not before >> goal & 1:
            taken[i] += k
            goal -= lengths[i] * k
    return taken


def take_plan(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(_s, size, rounds, extra): each document `rounds` times, and `extra` of this size once more.

    histogram: (_s, size, n). A task holds the lengths of one source, not its documents.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = min(MOST_TIMES, int(target // whole)) if whole else 0
        budget = 0 if rounds == MOST_TIMES or not whole else round(target - rounds * whole)
        extra = fit_counts(group["size"].tolist(), group["n"].tolist(), budget)
        return pd.DataFrame({"_s": group["_s"], "size": group["size"], "rounds": rounds, "extra": extra})

    keyed = histogram.join(targets, "_s").select("_s", "size", "n", "source_size", "target")
    return keyed.groupBy("_s").applyInPandas(fit, "_s string, size long, rounds int, extra long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """docs with a struct `_mix` of size, source_size, target and taken.

    Null and empty texts have no words and are never taken; null is a source of its own. Repeated
    rows are documents like others. Reruns agree: the hash is seeded, ties among equal hashes are
    between rows with the same key and length. An empty table gives an empty result. Other columns
    pass through, whatever their names, but one named _mix, which is replaced.
    """
    rows = _mixed(docs, key, text, source, seed)
    return rows.select(*named(docs.columns, "_mix"), "_mix")


def _mixed(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(given, _mix): the columns of docs packed in a struct, beside the mix."""
    name = F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source)))
    draw = F.xxhash64(F.lit(seed), F.col(key))
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select(name.alias("_s"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), draw.alias("draw")), "sizes")
    n_parts = max(PARTS, -(-sizes.count() // PART_ROWS))
    part = lambda c: F.pmod(c, F.lit(n_parts))
    targets = source_targets(sizes).withColumn("_s", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")))
    parts = sizes.groupBy("_s", "size", part(F.col("draw")).alias("part")).agg(F.count("*").alias("n"))
    plan = take_plan(parts.groupBy("_s", "size").agg(F.sum("n").alias("n")), targets)
    earlier = Window.partitionBy("_s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rest = F.struct("n", "rounds", (F.col("extra") - F.col("earlier")).alias("extra"), "source_size", "target")
    choice = scratch.save(
        parts.join(plan, ["_s", "size"]).join(targets, "_s").select("_s", F.col("size").alias("_n"), F.col("part").alias("_p"), rest.alias("_c")),
        "choice",
    )
    rank = F.xxhash64(F.col(key), F.lit(seed))
    rows = docs.select(given(docs), name.alias("_s"), n_words(F.col(text)).alias("_n"), part(draw).alias("_p"), rank.alias("_rank"))
    # A document goes in if fewer of its length come before it, by part and then by hash, than are wanted.
    place = F.row_number().over(Window.partitionBy("_s", "_n", "_p").orderBy("_rank"))
    extra = F.col("_c.extra")
    more = F.when(extra <= 0, 0).when(extra >= F.col("_c.n"), 1).otherwise(F.when(F.col("_place") <= extra, 1).otherwise(0))
    times = F.col("_c.rounds") + more
    mixed = F.struct(
        F.col("_n").alias("size"), "_c.source_size", "_c.target", (F.col("_n") * times).cast("long").alias("taken"), times.alias("times")
    )
    return rows.join(choice, ["_s", "_n", "_p"]).withColumn("_place", place).select("given", mixed.alias("_mix"))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns it came with, whatever
    their names. Rows without words are never taken; an empty table gives an empty result."""
    taken = _mixed(docs, key, text, source, seed).filter(F.col("_mix.taken") > 0)
    times = F.explode(F.array_repeat(F.lit(1), F.col("_mix.times").cast("int")))
    return taken.select("given", times.alias("time")).select(*named(docs.columns))
