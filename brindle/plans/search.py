"""The whole search: parse, filter, retrieve in lanes, fuse, blend, fold and rank, as one plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import filters, keyword, ranking, spelling, vectors
from brindle.plans import grammar
from brindle.plans.grammar import Parsed
from brindle.sources.corpus import BASE_NS, Corpus
from brindle.sources.store import kept

#: Rows of each lane that are fused, and words of the vocabulary that a pattern stands for at most.
LANE, MOST_FORMS = 100, 200


def search(corpus: Corpus, text: str, limit: int = 20, today: dt.date = dt.date(2024, 1, 1), relax: int = 2, vector: list[float] | None = None) -> DataFrame:
    """(place, id, path, score, sources, folded) of one typed query; if it finds nothing, up to `relax` looser forms.

    If just one of its words is in no document, the nearest spelling is searched in its place.

    A page is stored as it is found, so asking whether it is empty doesn't search twice.
    """
    q = grammar.parse(text, today)
    if grammar.looks_pasted(text) and not (q.phrases or q.filters or q.all_terms):
        q = Parsed(phrases=(grammar.pasted_phrase(text),))
    q = corrected(corpus, q)
    page = kept(ranked(corpus, q, limit, vector), "page")
    for _, looser in grammar.relaxations(q)[:relax]:
        if not page.isEmpty():
            break
        page = kept(ranked(corpus, looser, limit, vector), "page")
    return page


def forms(corpus: Corpus, word: str) -> list[tuple[str, ...]]:
    """What a typed word stands for, each a run of words of the vocabulary that follow each other: its own parts,
    its spellings as a number, and for a name in code its parts and them in one. Of a pattern, the words that
    it matches, commonest first."""
    w = word.lower()
    if set(w) & set("*?"):
        if sum(c.isalnum() for c in w) < 2:
            return []
        found = keyword.globbed(corpus, w).orderBy(F.desc("df"), "term").limit(MOST_FORMS)
        return [(r["term"],) for r in found.collect()]
    runs = [tuple(T.plain_words(f)) for f in (w, *grammar.number_forms(w))]
    parts = [p.lower() for p in grammar.identifier_parts(word)]
    if len(parts) > 1:
        runs.append(tuple(parts))
    if "_" in w.strip("_") and w.replace("_", "").isalnum():
        runs.append((w.replace("_", ""),))
    return [r for r in dict.fromkeys(runs) if r]


def matching(corpus: Corpus, q: Parsed) -> DataFrame | None:
    """(doc_id, score) of documents that the words of q ask for; None where q has no words.

    Alternatives of OR stand beside each other; within one, several words rank by how many match,
    or must all match after an AND. All forms of a word count as that word; of a form of several
    words, these must follow each other. A word that stands for nothing matches nothing.
    """
    rows, sizes, runs = [], [], {}
    for g, group in enumerate(q.groups or ((q.terms,) if q.terms else ())):
        words = grammar.content_words(group)
        sizes.append(len(words))
        for k, w in enumerate(words):
            for f in forms(corpus, w):
                run = runs.setdefault(f, len(runs)) if len(f) > 1 else -1
                rows += [(g, k, run, t) for t in dict.fromkeys(f)]
    if not sizes:
        return None
    asked = corpus.spark.createDataFrame(rows, "grp int, word int, run int, term string")
    met = asked.join(keyword.parts(corpus, asked.select("term")), "term")
    if runs:
        follow = [keyword.phrase(corpus, f).select("doc_id", F.lit(n).alias("run")) for f, n in runs.items()]
        whole = reduce(DataFrame.unionByName, follow).withColumn("follows", F.lit(True))
        met = met.join(whole, ["doc_id", "run"], "left").filter((F.col("run") < 0) | F.col("follows"))
    once = met.groupBy("doc_id", "grp", "word", "term").agg(F.first("part").alias("part"))
    met = once.groupBy("doc_id", "grp").agg(F.sum("part").alias("score"), F.countDistinct("word").alias("matched"))
    if q.all_terms:
        wanted = F.get(F.lit(sizes), F.col("grp"))
        met = met.filter(F.col("matched") == wanted)
    return met.groupBy("doc_id").agg(F.sum("score").alias("score"))


def corrected(corpus: Corpus, q: Parsed) -> Parsed:
    """q with its only word that no document has replaced by the nearest word of the vocabulary; q itself where
    all are known, more than one isn't, or nothing is near."""
    words = [w for g in (q.groups or (q.terms,)) for w in grammar.content_words(g)]
    known = {w: {t for f in forms(corpus, w) for t in f} for w in dict.fromkeys(words) if not set(w) & set("*?")}
    asked = sorted({t for ts in known.values() for t in ts})
    if not asked:
        return q
    have = {r["term"] for r in keyword.postings_of_words(corpus, asked).select("term").distinct().collect()}
    missing = [w for w, ts in known.items() if not ts & have]
    if len(missing) != 1:
        return q
    near = spelling.suggestions(corpus, corpus.spark.createDataFrame([(missing[0].lower(),)], "word string")).collect()
    if not near:
        return q
    swap = lambda ws: tuple(near[0]["suggestion"] if w == missing[0] else w for w in ws)
    return replace(q, terms=swap(q.terms), groups=tuple(swap(g) for g in q.groups))


def allowed(corpus: Corpus, q: Parsed) -> DataFrame:
    """Files under the filters, phrases and exclusions of q."""
    files = filters.apply(corpus.files, q, corpus)
    having = lambda words: keyword.phrase(corpus, words).withColumnRenamed("doc_id", "id")
    for p in q.phrases:
        files = files.join(having(T.plain_words(p.lower())), "id", "left_semi")
    for p in (*q.not_phrases, *q.excluded):
        files = files.join(having(T.plain_words(p.lower())), "id", "left_anti")
    return files


def ranked(corpus: Corpus, q: Parsed, limit: int, vector: list[float] | None = None) -> DataFrame:
    files = allowed(corpus, q)
    found = matching(corpus, q)
    lanes = []
    first = lambda df, by: df.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # noqa: E731  LANE rows at most
    if found is not None:
        best = found.withColumnRenamed("doc_id", "id").join(files.select("id"), "id", "left_semi").withColumn("score", F.round("score", 6))
        lanes.append(("keyword", first(best.orderBy(F.desc("score"), "id").limit(LANE), [F.desc("score"), F.col("id")])))
        lanes.append(("name", first(keyword.named_like(files, [w.lower() for w in q.content_terms()]).limit(LANE), [F.desc("score"), F.col("id")])))
    if vector is not None:
        near = vectors.nearest_to(corpus.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(files.select("id"), "id", "left_semi"), vector, LANE)
        lanes.append(("vector", first(near, [F.desc("sim"), F.col("id")])))
    if not lanes:
        order = files.withColumn("when_ns", filters.effective_ns()).orderBy(F.desc("when_ns"), "id").limit(limit)
        return first(order, [F.desc("when_ns"), F.col("id")]).select(F.col("rank").alias("place"), "id", "path", F.lit(0.0).alias("score"), F.lit("newest").alias("sources"), F.array().cast("array<bigint>").alias("folded"))
    fused = ranking.placed(ranking.fuse([(n, df.select(F.lit(0).cast("long").alias("qid"), "id", "rank")) for n, df in lanes]), LANE)
    met = fused.select("id", "rrf", "sources").join(files.select("id", "path", "mtime_ns", "content_hash"), "id")
    terms = [w.lower() for w in q.content_terms()]
    key = F.round("rrf", 9)
    if q.sort in ("newest", "oldest", "name"):
        order = {"newest": [F.desc("mtime_ns")], "oldest": [F.asc("mtime_ns")], "name": [F.lower(T.basename(F.col("path"))), F.col("path")]}[q.sort]
        met = met.withColumn("score", key)
    else:
        met = met.withColumn("score", F.round(ranking.filename_bonus(F.col("rrf"), F.col("path"), terms), 9))
        blend = ranking.recency(F.col("score"), F.col("mtime_ns"), BASE_NS)
        if len(terms) == 1 and ranking.is_symbol(terms[0]):
            text = corpus.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
            met = met.join(text, "id", "left").withColumn("declared", ranking.declares(F.col("body"), terms[0])).drop("body")
            blend = F.when(F.col("declared"), blend * ranking.DECLARATION_WEIGHT).otherwise(blend)
        order = [F.round(blend, 9).desc()]
    hits = first(met, [*order, F.col("id")]).select("rank", "id", "path", "mtime_ns", "content_hash", "score", "sources")
    page = ranking.fold(hits).orderBy("rank", "id").limit(limit)
    return first(page, [F.col("rank"), F.col("id")]).select(F.col("rank").alias("place"), "id", "path", "score", "sources", "folded")
