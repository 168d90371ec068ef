"""Queries on tables that are written to: changes, deletes and appends that take effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import keyword
from brindle.queries.registry import query, with_views
from brindle.queries.retrieval import RANKED, SCORES, TOP
from brindle.sources.corpus import Corpus
from brindle.sources.live import LiveIndex

NEW = 1_000_000_000
CHANGED = f"SELECT doc_id, text, lang, source, n_chars FROM main.documents WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 1 UNION ALL SELECT doc_id, 'quagga zebra ' || text, lang, source, n_chars + 13 FROM main.documents WHERE doc_id % 13 <> 0 AND doc_id % 7 = 1 UNION ALL SELECT doc_id + {NEW}, text, lang, source, n_chars FROM main.documents WHERE doc_id % 11 = 0"


def _as_of(documents: str, state: str) -> str:
    """The search's SQL on other documents."""
    body = with_views(TOP % (RANKED % SCORES, 10))
    return f"SELECT '{state}' AS state, * FROM (WITH documents AS ({documents}), {body[5:]})"


def _changed(c: Corpus) -> LiveIndex:
    """A thirteenth of the documents goes, a seventh changes, an eleventh comes again under new ids."""
    docs, d = c.table("documents"), F.col("doc_id")
    edited = docs.filter((d % 13 != 0) & (d % 7 == 1)).withColumn("text", F.concat(F.lit("quagga zebra "), "text")).withColumn("n_chars", F.col("n_chars") + 13)
    added = docs.filter(d % 11 == 0).withColumn("doc_id", d + NEW)
    index = LiveIndex(c)
    index.change(edited.unionByName(added), docs.filter(d % 13 == 0).select("doc_id"))
    return index


@query("index_upkeep", " UNION ALL ".join([_as_of(CHANGED, "changed"), _as_of(CHANGED, "compacted"), _as_of(f"SELECT * FROM ({CHANGED}) WHERE doc_id % 5 <> 2", "deleted")]))
def index_upkeep(c: Corpus):
    # The same search after changes, after compaction, and after a delete on top of both.
    index, out = _changed(c), None
    for state in ("changed", "compacted", "deleted"):
        if state == "compacted":
            index.compact()
        if state == "deleted":
            index.change(gone=index.rows("files").filter("id % 5 = 2").select("id"))
        now = index.reader()
        found = keyword.top(keyword.scores(now, now.searches).select("qid", "doc_id", "score"), 10).select(F.lit(state).alias("state"), "qid", "doc_id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


COUNTED = {"files": ("files", "id"), "passages": ("chunks", "file_id"), "tags": ("file_tags", "file_id"), "lengths": ("lengths", "doc_id"), "postings": ("postings", "doc_id"), "vectors": ("(SELECT vec_id // 10 AS file_id FROM embeddings)", "file_id")}


def _counts_sql(left: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS before, count(*) FILTER ({left.format(key=key)}) AS after FROM {table}" for n, (table, key) in COUNTED.items())


def _counts(index: LiveIndex, before):
    """Rows of each table for a reader that opened before the write and for one that opens now."""
    zero, out = F.lit(0).cast("long"), None
    for when, m in (("before", before), ("after", index.generations.newest())):
        for name in COUNTED:
            n = F.count("*")
            row = index.rows(name, m).agg((n if when == "before" else zero).alias("before"), (n if when == "after" else zero).alias("after"))
            row = row.select(F.lit(name).alias("tbl"), "before", "after")
            out = row if out is None else out.unionByName(row)
    return out.groupBy("tbl").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


@query("cascading_delete", _counts_sql("{key} % 13 <> 0"))
def cascading_delete(c: Corpus):
    index = LiveIndex(c)
    before = index.generations.newest()
    index.change(gone=index.rows("files").filter("id % 13 = 0").select("id"))
    return _counts(index, before)


@query("forget_folder", _counts_sql("{key} NOT IN (SELECT id FROM files WHERE starts_with(path, '/corpus/src2/'))"))
def forget_folder(c: Corpus):
    index = LiveIndex(c)
    before = index.generations.newest()
    index.change(gone=index.rows("files").filter(T.under_root(F.col("path"), "/corpus/src2")).select("id"))
    return _counts(index, before)


@query("append_vectors", "SELECT vec_id AS id, 'old' AS origin FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new' FROM embeddings WHERE vec_id % 4 <> 0")
def append_vectors(c: Corpus):
    # A batch is appended but for rows of another length.
    index, v = LiveIndex(c), F.col("embedding")
    batch = index.rows("vectors").select((F.col("id") + 1000000).alias("id"), "file_id", F.when(F.col("id") % 4 == 0, F.slice(v, 1, 3)).otherwise(v).alias("embedding"))
    index.append_vectors(batch)
    return index.rows("vectors").select("id", F.when(F.col("id") >= 1000000, "new").otherwise("old").alias("origin"))
