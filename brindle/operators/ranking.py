"""Fusion of ranked lists and the blends, folds and groupings that follow it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources.store import kept

RRF_K = 60
RECENCY_WEIGHT, HALF_LIFE_DAYS = 0.03, 180
FILENAME_WEIGHT, DECLARATION_WEIGHT = 1.05, 1.40
DAY_NS = 86_400_000_000_000

# Words of programming languages that a declared name follows.
TYPE_WORDS = ("class", "interface", "struct", "enum", "trait", "record", "union", "protocol", "namespace", "module", "type")
ROUTINE_WORDS = ("def", "func", "fn", "function", "fun", "sub", "procedure")
VALUE_WORDS = ("const", "let", "var", "val")
STORED_WORDS = ("table", "view", "index", "trigger")


def fuse(lists: list[tuple[str, DataFrame]], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(qid, id, rrf, sources) of lists of (qid, id, rank) by reciprocal ranks.

    An id counts once a list, at its best rank; lists of weight 0 are left out. Ties go to the
    earlier best rank, then to the earlier list, then to the id.
    """
    rows = None
    for n, (name, ranked) in enumerate(lists):
        w = (weights or {}).get(name, 1.0)
        if w:
            own = ranked.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
            own = own.select("qid", "id", "rank", F.lit(n).alias("list"), F.lit(name).alias("name"), (F.lit(w) / (k + F.col("rank"))).alias("part"))
            rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("qid", "id").agg(
        F.round(F.sum("part"), 9).alias("rrf"), F.min(F.struct("rank", "list")).alias("first"), F.array_join(F.sort_array(F.collect_set("name")), "+").alias("sources")
    )


def placed(fused: DataFrame, limit: int, score: str = "rrf") -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(score), "first.rank", "first.list", "id")
    return fused.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def freshness(mtime_ns: Column, now_ns: int) -> Column:
    age = (F.lit(now_ns) - mtime_ns) / DAY_NS
    return F.when(mtime_ns.isNull() | (mtime_ns <= 0), 0.0).when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS))


def recency(score: Column, mtime_ns: Column, now_ns: int, weight: float = RECENCY_WEIGHT) -> Column:
    """An order key; the score itself stays as it is."""
    return score * (1 + weight * freshness(mtime_ns, now_ns))


def filename_bonus(score: Column, path: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | T.whole_word(T.basename(path), t)
    return F.when(hit, score * FILENAME_WEIGHT).otherwise(score)


def is_symbol(word: str) -> bool:
    return len(word) >= 3 and word.isascii() and word.isidentifier()


def declares(text: Column, name: str) -> Column:
    """Whether a line of the text declares the name: after a word that declares, with a value, or with a body."""
    word = re.escape(name)
    after = "|".join((*TYPE_WORDS, *ROUTINE_WORDS, *VALUE_WORDS, *(f"create +{w}" for w in STORED_WORDS)))
    opened = rf"\b{word} *\([^()\n]*\) *\{{"
    given = rf"^[ \t]*\"?{word}\"?[ \t]*(?::=?|=)[^=\n]"
    return text.rlike(rf"(?im)(?:\b(?:{after})[ \t]+{word}\b)|(?:{given})|(?:{opened})")


def declaration_bonus(score: Column, text: Column, name: str) -> Column:
    return F.when(declares(text, name), score * DECLARATION_WEIGHT).otherwise(score)


def positions(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank`, their place in the order over the whole table, counted from 1.

    Rows are dealt to ranges of the order and stored; the driver gets one count a range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt, "positions")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_part").count().collect()):
        offsets += [F.lit(part), F.lit(before).cast("long")]
        before += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    offset = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    return dealt.withColumn("rank", own + offset).drop("_part")


def fold_copies(hits: DataFrame) -> DataFrame:
    """One row a content: the newest file as head, at the group's best place; unhashed files stay alone."""
    group = F.coalesce("content_hash", F.concat(F.lit("#"), F.col("id").cast("string")))
    return hits.withColumn("g", group).groupBy("g").agg(
        F.max_by("id", F.struct("mtime_ns", -F.col("id"))).alias("head"), F.min("rank").alias("position"), (F.count("*") - 1).alias("older")
    ).drop("g")


def _heads(hits: DataFrame, group: Column) -> DataFrame:
    """Of each group the newest row, with the group's best rank and all of its ids."""
    newest = F.struct("mtime_ns", -F.col("id"))
    return hits.withColumn("g", group).groupBy("g").agg(
        *[F.max_by(c, newest).alias(c) for c in hits.columns if c not in ("rank", "folded")], F.min("rank").alias("rank"),
        F.flatten(F.collect_list("folded")).alias("folded"),
    ).drop("g")


def fold(hits: DataFrame) -> DataFrame:
    """A page of hits (rank, id, path, mtime_ns, content_hash) with copies and versions as one row each.

    First equal contents, then files of one folder, family and extension of which one at least bears a
    version mark. The newest stands for its group, at the group's best place; `folded` has the others.
    """
    rows = _heads(hits.withColumn("folded", F.array("id")), F.coalesce("content_hash", F.concat(F.lit("#"), F.col("id").cast("string"))))
    path = F.col("path")
    family = F.concat_ws("\u0001", F.lower(F.regexp_replace(path, "[^/]*$", "")), T.version_family(path), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)))
    marked = rows.withColumn("family", family)
    several = marked.groupBy("family").agg(F.count("*").alias("n"), F.max(T.has_version_mark(path)).alias("marked")).filter("n > 1 and marked").select("family", "marked")
    rows = marked.join(several, "family", "left").withColumn("key", F.when(F.col("marked"), F.col("family")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    out = _heads(rows.drop("family", "marked"), F.col("key")).drop("key")
    return out.withColumn("folded", F.array_sort(F.array_remove("folded", F.col("id"))))


def by_document(hits: DataFrame) -> DataFrame:
    """The best passage of each file, ranked anew within its query."""
    best = hits.groupBy("qid", "file_id").agg(F.min(F.struct("rank", "chunk_id")).alias("b"))
    return best.select("qid", "file_id", F.col("b.chunk_id").alias("chunk_id"), F.row_number().over(Window.partitionBy("qid").orderBy("b.rank", "file_id")).alias("rank"))
