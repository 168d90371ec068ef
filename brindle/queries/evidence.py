"""Whole searches, code and commits, and answers held against their sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import answers, code, filters, keyword, passages, ranking, vectors
from brindle.plans import questions
from brindle.plans.grammar import identifier_parts, parse, pasted_phrase
from brindle.plans.search import allowed, forms, matching, search
from brindle.queries.registry import query
from brindle.queries.retrieval import COS, DECLARED, MARKED, RANKED, RENAMED, SCORES, TOP, VERSIONS
from brindle.sources.corpus import BASE_NS, DAY_NS, SQL_VIEWS, Corpus

TODAY = dt.date(2024, 1, 1)
BASENAME = "regexp_extract(path, '[^/]*$')"
BREAK = r"'[^\p{L}\p{N}]+'"

# ---- whole searches


def _part(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT p.doc_id, p.term, greatest(ln((t.n - v.df + 0.5) / (v.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / t.mean)) AS part FROM postings p JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) v ON v.term = p.term JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN (SELECT count(*) AS n, avg(len) AS mean FROM lengths) t WHERE p.term IN ({listed})"


def _page(terms: list[str], where: str, order: str = "") -> str:
    """The keyword and name lanes of plain words fused, blended, folded by content and cut to 20."""
    named = " + ".join(f"10 * CAST(contains(lower({BASENAME}), '{t}') AS INT) + CAST(contains(lower(regexp_replace(path, '[^/]*$', '')), '{t}') AS INT)" for t in terms)
    bonus = " OR ".join(f"regexp_matches({BASENAME.replace('(path', '(f.path')}, '(?i)(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in terms)
    fresh = f"pow(0.5, (({BASE_NS} - mtime_ns) / {DAY_NS}.0) / 180)"
    order = order or f"round(score * (1 + 0.03 * {fresh}), 9) DESC, id"
    return f"""WITH ok AS (SELECT * FROM files WHERE {where}),
k AS (SELECT doc_id AS id, round(sum(part), 6) AS score FROM ({_part(terms)}) WHERE doc_id IN (SELECT id FROM ok) GROUP BY 1),
kr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 100),
nr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {named} AS score FROM ok) WHERE score > 0 QUALIFY rank <= 100),
fu AS (SELECT id, round(sum(p), 9) AS rrf, min((rank, l)) AS first, string_agg(name, '+' ORDER BY name) AS sources FROM (SELECT id, rank, 0 AS l, 'keyword' AS name, 1.0 / (60 + rank) AS p FROM kr UNION ALL SELECT id, rank, 1, 'name', 1.0 / (60 + rank) FROM nr) GROUP BY 1),
pl AS (SELECT * FROM fu QUALIFY row_number() OVER (ORDER BY rrf DESC, first, id) <= 100),
sc AS (SELECT f.id, f.path, f.mtime_ns, f.content_hash, pl.sources, round(CASE WHEN {bonus} THEN rrf * 1.05 ELSE rrf END, 9) AS score FROM pl JOIN files f ON f.id = pl.id),
rk AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM sc),
fo AS (SELECT max_by(id, (mtime_ns, -id)) AS id, max_by(path, (mtime_ns, -id)) AS path, max_by(score, (mtime_ns, -id)) AS score, min(rank) AS rank, count(*) - 1 AS folded FROM rk GROUP BY coalesce(content_hash, '#' || id))
SELECT row_number() OVER (ORDER BY rank, id) AS place, id, path, score, folded FROM fo QUALIFY place <= 20"""


def _shown(page):
    return page.select("place", "id", "path", "score", F.size("folded").alias("folded"))


@query("search_full", _page(["license", "version"], f"ext IN ('txt', 'md', 'pdf', 'docx') AND coalesce(taken_at_ns, mtime_ns) >= {18262 * DAY_NS}"))
def search_full(c: Corpus):
    return _shown(search(c, "license version type:txt,md,pdf,docx after:2020", limit=20))


@query("search_instructions", _page(["license"], "true"))
def search_instructions(c: Corpus):
    # Words that only instruct are no words to look for.
    return _shown(search(c, "find the latest license", limit=20))


@query("search_relaxed", _page(["license"], "true"))
def search_relaxed(c: Corpus):
    # No file is of this type: the filter goes.
    return _shown(search(c, "license type:zzz", limit=20))


@query("search_misspelt", _page(["license", "version"], "true"))
def search_misspelt(c: Corpus):
    # One word is in no document: its nearest spelling is searched.
    return _shown(search(c, "licensse version", limit=20))


@query("search_by_name_order", _page(["license", "version"], "true", f"lower({BASENAME}), path").replace("CASE WHEN", "CASE WHEN false AND", 1))
def search_by_name_order(c: Corpus):
    return _shown(search(c, "license version sort:name", limit=20))


@query("search_or", f"SELECT doc_id, round(sum(part), 6) AS score FROM ({_part(['license', 'version', 'apache'])}) WHERE doc_id IN (SELECT doc_id FROM postings WHERE term = 'license') AND doc_id IN (SELECT doc_id FROM postings WHERE term = 'version') AND term IN ('license', 'version') OR term = 'apache' GROUP BY 1")
def search_or(c: Corpus):
    # (license AND version) OR apache
    return matching(c, parse("license AND version OR apache", TODAY)).select("doc_id", F.round("score", 6).alias("score"))


@query("search_phrase_not_phrase", "SELECT id FROM files WHERE id IN (SELECT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') AND id NOT IN (SELECT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'apache' AND b.term = 'license') AND id NOT IN (SELECT doc_id FROM postings WHERE term = 'idiot')")
def search_phrase_not_phrase(c: Corpus):
    return allowed(c, parse('"of the" -"Apache License" -idiot', TODAY)).select("id")


@query("search_wildcard", "SELECT doc_id, count(DISTINCT term) AS n FROM postings WHERE term IN (SELECT term FROM postings WHERE regexp_matches(term, '^lic.*e$') GROUP BY term ORDER BY count(*) DESC, term LIMIT 200) GROUP BY 1")
def search_wildcard(c: Corpus):
    typed = "lic*e"
    return keyword.counts_of_words(c, [w for w, in forms(c, typed)], [T.glob_piece(typed)]).groupBy("doc_id").agg(F.countDistinct("term").alias("n"))


FOLLOW = "SELECT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = '2' AND b.term = '373'"


@query("search_number", f"SELECT doc_id, round(sum(part), 6) AS score FROM ({_part(['2', '373', '2373'])}) WHERE term = '2373' OR doc_id IN ({FOLLOW}) GROUP BY 1")
def search_number(c: Corpus):
    return matching(c, parse("2,373", TODAY)).select("doc_id", F.round("score", 6).alias("score"))


PASTED = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(%s), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')%s, ' ') || ' '"


@query("search_pasted", f"SELECT d.doc_id FROM documents b JOIN documents d ON contains({PASTED % ('d.text', '')}, {PASTED % ('b.text', '[1:24]')}) WHERE b.doc_id = 1")
def search_pasted(c: Corpus):
    # A copied text is one phrase of its first words.
    text = c.table("documents").filter("doc_id = 1").first()["text"]
    return keyword.phrase(c, T.plain_words(pasted_phrase(text).lower())[:24])


@query("search_vector_lane", f"SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT b.vec_id AS id, round({COS}, 6) AS sim FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id = 0 AND b.vec_id IN (SELECT id FROM files WHERE ext = 'pdf')) QUALIFY rank <= 20")
def search_vector_lane(c: Corpus):
    q = [float(x) for x in c.table("embeddings").filter("vec_id = 0").first()["embedding"]]
    ok = filters.apply(c.files, parse("type:pdf", TODAY), c).select("id")
    pool = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(ok, "id", "left_semi")
    near = vectors.nearest_to(pool, q, 20)
    return near.select("id", F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("rank"))


@query("search_with_vector", None)
def search_with_vector(c: Corpus):
    q = [float(x) for x in c.table("embeddings").filter("vec_id = 0").first()["embedding"]]
    return _shown(search(c, "license type:pdf", limit=20, vector=q))


@query("search_interim", "SELECT doc_id, count(DISTINCT term) AS n FROM postings WHERE term = 'licensed' OR starts_with(term, 'und') GROUP BY 1")
def search_interim(c: Corpus):
    # As one types: the last word counts as a beginning, from three letters on.
    return keyword.counts_where(c, lambda w: (w == "licensed") | w.startswith("und"), ["licensed", "und"]).groupBy("doc_id").agg(F.countDistinct("term").alias("n"))


COMMON = "SELECT term FROM postings GROUP BY term HAVING count(*) >= 0.1 * (SELECT count(*) FROM lengths)"


@query("bm25_without_common", f"WITH kept AS (SELECT s.qid, s.term FROM searches s WHERE s.term NOT IN ({COMMON}) OR s.qid NOT IN (SELECT qid FROM searches WHERE term NOT IN ({COMMON}) AND term IN (SELECT term FROM postings))) " + TOP % (RANKED % SCORES.replace("FROM searches s", "FROM kept s"), 10))
def bm25_without_common(c: Corpus):
    return keyword.top(keyword.scores(c, keyword.without_common(c, c.searches)).select("qid", "doc_id", "score"), 10)


@query("match_share", "WITH n AS (SELECT id FROM files ORDER BY mtime_ns DESC, id LIMIT 200) SELECT s.term, round(count(DISTINCT p.doc_id) / 200.0, 6) AS share FROM (SELECT DISTINCT term FROM searches) s LEFT JOIN postings p ON p.term = s.term AND p.doc_id IN (SELECT id FROM n) GROUP BY 1")
def match_share(c: Corpus):
    # The share of the newest 200 files that a word is in.
    newest = c.files.select(F.col("id").alias("doc_id"), "mtime_ns").orderBy(F.desc("mtime_ns"), "doc_id").limit(200).select("doc_id")
    asked = c.searches.select("term").distinct()
    hits = keyword.postings_of(c, asked).select("term", "doc_id").join(newest, "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return asked.join(hits, "term", "left").select("term", F.round(F.coalesce("n", F.lit(0)) / 200.0, 6).alias("share"))


@query("filter_only_browse", f"SELECT f.id, c.id AS chunk_id FROM (SELECT id, coalesce(taken_at_ns, mtime_ns) AS w FROM files WHERE ext = 'pdf' ORDER BY w DESC, id LIMIT 50) f JOIN chunks c ON c.file_id = f.id AND c.ordinal = 0")
def filter_only_browse(c: Corpus):
    newest = filters.apply(c.files, parse("type:pdf", TODAY), c).select("id", filters.effective_ns().alias("w")).orderBy(F.desc("w"), "id").limit(50)
    first = c.chunks.filter("ordinal = 0").select(F.col("file_id").alias("id"), F.col("id").alias("chunk_id"))
    return newest.join(first, "id").select("id", "chunk_id")


@query("files_browse_count", "SELECT count(*) AS n FROM (SELECT id FROM files WHERE contains(path, 'doc_1') UNION SELECT doc_id FROM postings WHERE term = 'license' LIMIT 101)")
def files_browse_count(c: Corpus):
    names = c.files.filter(F.col("path").contains("doc_1")).select("id")
    return names.union(keyword.counts_of_words(c, ["license"]).select("doc_id")).distinct().limit(101).agg(F.count("*").alias("n"))


@query("sort_newest", TOP % ("SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY f.mtime_ns DESC, doc_id) AS rank FROM (%s) s JOIN files f ON f.id = s.doc_id" % SCORES, 5))
def sort_newest(c: Corpus):
    met = keyword.scores(c, c.searches).join(c.files.select(F.col("id").alias("doc_id"), "mtime_ns"), "doc_id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("mtime_ns"), "doc_id"))
    return met.select("qid", "doc_id", place.alias("rank")).filter("rank <= 5")


SETS = "SELECT doc_id, list_distinct(list(term)) AS w FROM postings GROUP BY 1"


@query("rerank_page", f"SELECT t.qid, t.doc_id, row_number() OVER (PARTITION BY t.qid ORDER BY round(CAST(len(list_intersect(q.w, d.w)) AS DOUBLE) / len(list_distinct(list_concat(q.w, d.w))), 9) DESC, t.rank) AS place FROM ({TOP % (RANKED % SCORES, 30)}) t JOIN (SELECT qid, list(DISTINCT term) AS w FROM searches GROUP BY 1) q ON q.qid = t.qid JOIN ({SETS}) d ON d.doc_id = t.doc_id")
def rerank_page(c: Corpus):
    # The best 30 in order of the words that they share with the query; ties stay as they were.
    page = keyword.top(keyword.scores(c, c.searches).select("qid", "doc_id", "score"), 30)
    asked = c.searches.groupBy("qid").agg(F.collect_set("term").alias("q"))
    words = c.table("documents").select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("w"))
    share = F.round(F.size(F.array_intersect("q", "w")) / F.size(F.array_union("q", "w")), 9)
    met = page.join(asked, "qid").join(words, "doc_id").withColumn("s", share)
    return met.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "rank")).alias("place"))


@query("fold_versions", f"WITH r AS (SELECT n.id, n.path, f.mtime_ns, f.content_hash, row_number() OVER (ORDER BY f.size_bytes DESC, n.id) AS rank FROM ({RENAMED}) n JOIN files f ON f.id = n.id WHERE f.ext = 'md' QUALIFY rank <= 60), a AS (SELECT max_by(id, (mtime_ns, -id)) AS id, max_by(path, (mtime_ns, -id)) AS path, max(mtime_ns) AS mtime_ns, min(rank) AS rank, count(*) AS n FROM r GROUP BY coalesce(content_hash, '#' || id)), k AS (SELECT *, lower(regexp_replace(path, '[^/]*$', '')) || '|' || array_to_string(w[1:coalesce(list_max(list_transform(w, lambda x, i: CASE WHEN x IN {VERSIONS} THEN 1 ELSE i END)), 1)], ' ') AS family, coalesce(w[-1] IN {VERSIONS}, false) AS marked FROM (SELECT *, {MARKED} AS w FROM a)), g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY family) > 1 AND bool_or(marked) OVER (PARTITION BY family) THEN family ELSE '#' || id END AS key FROM k) SELECT max_by(id, (mtime_ns, -id)) AS id, min(rank) AS rank, CAST(sum(n) - 1 AS BIGINT) AS folded FROM g GROUP BY key")
def fold_versions(c: Corpus):
    i = F.col("id") % 6
    mark = F.when(i == 0, "_v2.1.").when(i == 1, " (1).").when(i == 2, "_final_draft.").when(i == 3, "-2024-01-05 copy.").when(i == 4, "_semifinal.").otherwise(".")
    page = c.files.filter("ext = 'md'").orderBy(F.desc("size_bytes"), "id").limit(60)
    hits = page.select("id", F.replace("path", F.lit("."), mark).alias("path"), "mtime_ns", "content_hash", F.row_number().over(Window.orderBy(F.desc("size_bytes"), "id")).alias("rank"))
    return ranking.fold(hits).select("id", "rank", F.size("folded").cast("long").alias("folded"))


@query("status_marks", "SELECT f.id, CASE WHEN v.state IN ('OFFLINE', 'ARCHIVED') THEN 'OFFLINE' WHEN f.id % 17 = 0 THEN 'MISSING' ELSE 'OK' END AS mark FROM files f LEFT JOIN volumes v ON f.volume_id = v.id")
def status_marks(c: Corpus):
    at = c.volumes.select(F.col("id").alias("volume_id"), "state")
    there = c.files.filter("id % 17 != 0").select("id", F.lit(True).alias("there"))
    met = c.files.select("id", "volume_id").join(at, "volume_id", "left").join(there, "id", "left")
    return met.select("id", F.when(F.col("state").isin("OFFLINE", "ARCHIVED"), "OFFLINE").when(F.col("there").isNull(), "MISSING").otherwise("OK").alias("mark"))


@query("explain_hits", f"SELECT qid, id, string_agg(name || ' #' || rank, ', ' ORDER BY name) AS why FROM (SELECT qid, doc_id AS id, rank, 'keyword' AS name FROM ({TOP % (RANKED % SCORES, 10)}) UNION ALL SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY len DESC, doc_id), 'long' FROM (SELECT DISTINCT s.qid, p.doc_id, l.len FROM searches s JOIN postings p ON p.term = s.term JOIN lengths l ON l.doc_id = p.doc_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY len DESC, doc_id) <= 10) GROUP BY 1, 2")
def explain_hits(c: Corpus):
    best = keyword.top(keyword.scores(c, c.searches).select("qid", "doc_id", "score"), 10).select("qid", F.col("doc_id").alias("id"), "rank", F.lit("keyword").alias("name"))
    met = keyword.postings_of(c, c.searches).select("term", "doc_id", "len").join(c.searches, "term").groupBy("qid", "doc_id").agg(F.max("len").cast("double").alias("score"))
    long = keyword.top(met, 10).select("qid", F.col("doc_id").alias("id"), "rank", F.lit("long").alias("name"))
    words = F.concat("name", F.lit(" #"), F.col("rank").cast("string"))
    return best.unionByName(long).groupBy("qid", "id").agg(F.array_join(F.sort_array(F.collect_list(words)), ", ").alias("why"))


@query("recall_by_language", f"SELECT lang, round(avg(hit), 6) AS recall, count(*) AS asked FROM (SELECT q.qid, q.lang, max(CASE WHEN t.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit FROM (SELECT b.item_id AS qid, d.doc_id, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)) q LEFT JOIN ({TOP % (RANKED % SCORES, 10)}) t ON q.qid = t.qid AND q.doc_id = t.doc_id GROUP BY 1, 2) GROUP BY 1")
def recall_by_language(c: Corpus):
    asked = c.table("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    docs, holds = c.table("documents"), F.col("text").contains(F.col("passage"))
    right = None
    for block in vectors.blocks(asked, "qid"):
        met = docs.join(F.broadcast(block), holds).select("qid", "doc_id", "lang")
        right = met if right is None else right.unionByName(met)
    found = keyword.top(keyword.scores(c, c.searches).select("qid", "doc_id", "score"), 10).select("qid", "doc_id", F.lit(1.0).alias("found"))
    hit = right.join(found, ["qid", "doc_id"], "left").groupBy("qid", "lang").agg(F.max(F.coalesce("found", F.lit(0.0))).alias("hit"))
    return hit.groupBy("lang").agg(F.round(F.avg("hit"), 6).alias("recall"), F.count("*").alias("asked"))


@query("federated_commits", "SELECT rank, kind, key FROM (SELECT row_number() OVER (ORDER BY size_bytes DESC, id) AS rank, 'file' AS kind, id AS key FROM files QUALIFY rank <= 10) UNION ALL SELECT 10 + row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey), 'commit', o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) <= 10")
def federated_commits(c: Corpus):
    page = lambda df, order, key, kind, start: df.orderBy(*order).limit(10).select((F.row_number().over(Window.orderBy(*order)) + start).alias("rank"), F.lit(kind).alias("kind"), F.col(key).alias("key"))
    files = page(c.files, [F.desc("size_bytes"), F.col("id")], "id", "file", 0)
    return files.unionByName(page(c.table("orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], "o_orderkey", "commit", 10))


MARK = r"[^\p{L}\p{N}_\s''\-,.?!]"
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query("pasted_texts", rf"SELECT doc_id FROM (SELECT doc_id, length(t) AS chars, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(t, '{MARK}')) + 2 * len(regexp_extract_all(t, '{MARK}{{2,}}')) + 3 * len(regexp_extract_all(t, '\n')) + 3 * CAST(regexp_matches(t, '^[\p{{L}}\p{{N}}_]+:\s') AS INT) AS weight FROM (SELECT doc_id, {STRIPPED} AS t FROM documents)) WHERE chars >= 24 AND words >= 4 AND weight >= 3 AND 4 * weight >= words")
def pasted_texts(c: Corpus):
    return c.table("documents").filter(T.pasted(F.col("text"))).select("doc_id")


@query("sentence_filters", "SELECT id FROM listing WHERE ext IN ('eml', 'msg', 'pst', 'mbox') AND id IN (SELECT mail_id FROM messages WHERE contains(lower(sender), 'assistant')) AND coalesce(taken_at_ns, mtime_ns) BETWEEN 1704067200000000000 AND 1735689599999999000")
def sentence_filters(c: Corpus):
    return filters.apply(c.listing, questions.filters_of("emails from Assistant in 2024"), c).select("id")


# ---- text


@query("html_to_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|tr|li|h[1-6]|table|blockquote)\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '$Q'), '&#39;', '$A'), '&amp;', '&'), '[ \t\x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM pages".replace("$Q", '"').replace("$A", "''"))
def html_to_text(c: Corpus):
    return c.table("pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("whitespace", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def whitespace(c: Corpus):
    return c.table("documents").select("doc_id", F.md5(T.normal_space(F.col("text")).cast("binary")).alias("h"))


QUOTED = "text || CASE file_id % 4 WHEN 0 THEN chr(10) || 'On Monday X wrote:' || chr(10) || '> old' WHEN 1 THEN chr(10) || '-- ' || chr(10) || 'Jo' WHEN 2 THEN chr(10) || '> cited' || chr(10) || 'end' ELSE '' END"


@query("quote_strip", rf"SELECT file_id, CASE WHEN length(h) < 2 THEN t ELSE h END AS text FROM (SELECT file_id, t, trim(regexp_replace(regexp_replace(regexp_split_to_array(t, '(?m)^(?:-----Original Message-----|On .* wrote:|From: .*|_{{5,}}|-- ?|Best regards,?|Kind regards,?|Sent from my .*)\s*$')[1], '(?m)^>.*$\n?', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ') AS h FROM (SELECT file_id, {QUOTED} AS t FROM messages))")
def quote_strip(c: Corpus):
    i = F.col("file_id") % 4
    end = F.when(i == 0, "\nOn Monday X wrote:\n> old").when(i == 1, "\n-- \nJo").when(i == 2, "\n> cited\nend").otherwise("")
    return c.messages.select("file_id", T.unquoted(F.concat("text", end)).alias("text"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}])(Mr|Mrs|Ms|Dr|Prof|St|No|vs|etc|[A-Z])\.', '\1\2~', 'g'), '([.!?][\x22\x27)\]]*)\s+', '\1|~|', 'g'), '\|~\|'), lambda s: trim(s)), lambda s: s <> '')) AS n FROM documents")
def sentence_counts(c: Corpus):
    return c.table("documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query("symbol_tokens", r"SELECT p_partkey, list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: length(w) >= 2), lambda w: lower(w))).list_sort() AS parts FROM (SELECT p_partkey, replace(p_name, ' ', '') || 'Of' || replace(p_brand, '#', '') || ' ofTYPE' AS n FROM part)")
def symbol_tokens(c: Corpus):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("Of"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" ofTYPE"))
    return c.table("part").select("p_partkey", F.sort_array(T.symbol_tokens(name)).alias("parts"))


@query("identifier_terms", "SELECT doc_id FROM postings WHERE term = 'andanor' UNION SELECT doc_id FROM (SELECT doc_id FROM postings WHERE term = 'and' INTERSECT SELECT doc_id FROM postings WHERE term = 'an' INTERSECT SELECT doc_id FROM postings WHERE term = 'or')")
def identifier_terms(c: Corpus):
    # andAnOr: the word itself, or all of its parts.
    typed = "andAnOr"
    parts = [p.lower() for p in identifier_parts(typed)]
    hits = keyword.counts_of_words(c, [typed.lower(), *parts]).groupBy("doc_id").agg(F.max((F.col("term") == typed.lower()).cast("int")).alias("whole"), F.count_if(F.col("term").isin(*parts)).alias("n"))
    return hits.filter((F.col("whole") == 1) | (F.col("n") == len(parts))).select("doc_id")


@query("chunk_pages", "SELECT file_id AS doc_id, id, 1 + (SELECT count(*) FROM range(1, 200) r(k) WHERE k * 1000 <= o.start) AS page FROM (SELECT id, file_id, ordinal * 400 AS start FROM chunks) o")
def chunk_pages(c: Corpus):
    # A page ends at each thousandth character.
    breaks = c.table("documents").select("doc_id", F.explode(F.sequence(F.lit(1000), F.lit(199000), F.lit(1000))).alias("at"))
    spans = c.chunks.select(F.col("file_id").alias("doc_id"), "id", (F.col("ordinal") * 400).alias("start"))
    return passages.with_pages(spans, breaks).select("doc_id", "id", "page")


CARDS = "SELECT d.doc_id, regexp_extract(p.text, '[0-9]{4,}') AS amount, substr(p.text, 1, 12) AS name, d.text FROM documents d JOIN documents p ON p.doc_id = d.doc_id - d.doc_id % 2"


@query("card_grounding", f"SELECT doc_id, amount <> '' AND contains(regexp_replace(text, '[^0-9]', '', 'g'), amount) AS amount_ok, contains(lower(text), lower(name)) AS name_ok FROM ({CARDS})")
def card_grounding(c: Corpus):
    # What a card says of a document must literally occur in it; every other card is its neighbour's.
    docs = c.table("documents")
    said = docs.select(F.col("doc_id").alias("of"), F.regexp_extract("text", "[0-9]{4,}", 0).alias("amount"), F.substring("text", 1, 12).alias("name"))
    met = docs.select("doc_id", "text", (F.col("doc_id") - F.col("doc_id") % 2).alias("of")).join(said, "of")
    digits = F.regexp_replace("text", "[^0-9]", "")
    return met.select("doc_id", ((F.col("amount") != "") & digits.contains(F.col("amount"))).alias("amount_ok"), F.lower("text").contains(F.lower("name")).alias("name_ok"))


@query("doc_card_counts", f"SELECT CASE WHEN amount_ok AND name_ok THEN 'kept' WHEN name_ok THEN 'no amount' ELSE 'dropped' END AS outcome, count(*) AS n FROM (SELECT amount <> '' AND contains(regexp_replace(text, '[^0-9]', '', 'g'), amount) AS amount_ok, contains(lower(text), lower(name)) AS name_ok FROM ({CARDS})) GROUP BY 1")
def doc_card_counts(c: Corpus):
    outcome = F.when(F.col("amount_ok") & F.col("name_ok"), "kept").when(F.col("name_ok"), "no amount").otherwise("dropped")
    return card_grounding(c).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("amount_grounding", r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')))) AS amounts FROM documents WHERE regexp_matches(text, '[0-9]')")
def amount_grounding(c: Corpus):
    docs = c.table("documents").filter(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", F.sort_array(answers.numbers(F.col("text"))).alias("amounts"))


# ---- code and commits

CODE = "SELECT id, path, replace(text, ' token = ', chr(10) || 'token = ') AS text FROM files WHERE ext = 'py'"
LINES = f"SELECT id, path, i - 1 AS line, l AS text FROM (SELECT id, path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({CODE}))"


def _code(c: Corpus):
    return c.texts.filter("ext = 'py'").select("id", "path", F.replace("text", F.lit(" token = "), F.lit("\ntoken = ")).alias("text"))


@query("code_matches", f"SELECT row_number() OVER (ORDER BY kind, path, line) AS place, * FROM (SELECT CASE WHEN regexp_matches(text, '{DECLARED}') THEN 'definition' ELSE 'mention' END AS kind, id, path, line, text FROM (SELECT id, path, trim(text, ' ') AS text, min(line) AS line FROM ({LINES}) WHERE trim(text, ' ') <> '' AND contains(lower(text), 'token') GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY line) <= 3) QUALIFY place <= 200")
def code_matches(c: Corpus):
    return code.matches(_code(c), ["token"])


@query("code_resolve_line", f"WITH o AS (SELECT id, line, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here FROM ({LINES})), w AS (SELECT id, trim(text, ' ') AS text, 300 AS at FROM o WHERE line = 1 AND trim(text, ' ') <> '') SELECT w.id, arg_min(o.line, (abs(o.here - w.at), o.line)) + 1 AS line FROM w JOIN o ON o.id = w.id WHERE starts_with(trim(o.text, ' '), w.text) OR (length(w.text) > 20 AND contains(trim(o.text, ' '), w.text)) GROUP BY 1")
def code_resolve_line(c: Corpus):
    files = _code(c)
    wanted = code.lines(files).filter("line = 1").select("id", F.trim("text").alias("text"), F.lit(300).alias("at")).filter("text != ''")
    return code.resolved(wanted, files.select("id", "path", "text")).select("id", "line")


@query("code_by_repo", f"SELECT r.name AS repo, f.id, l.line FROM ({LINES}) l JOIN files f ON f.id = l.id JOIN repos r ON r.id = f.repo_id WHERE contains(lower(l.text), 'token') QUALIFY row_number() OVER (PARTITION BY r.name ORDER BY f.id, l.line) <= 5")
def code_by_repo(c: Corpus):
    named = c.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    hits = code.lines(_code(c)).filter(F.lower("text").contains("token")).select("id", "line")
    met = hits.join(c.files.select("id", "repo_id"), "id").join(named, "repo_id")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("id", "line"))).filter("r <= 5").select("repo", "id", "line")


@query("grep_output", f"SELECT path, line + 1 AS line, text FROM ({LINES}) WHERE contains(lower(text), 'license')")
def grep_output(c: Corpus):
    # Lines as a search prints them, path:line:text, read back into columns.
    printed = code.lines(_code(c)).filter(F.lower("text").contains("license")).select(F.concat("path", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(":"), "text").alias("out"))
    field = lambda n: F.regexp_extract("out", r"(?s)^(.*?):([0-9]+):(.*)$", n)
    return printed.select(field(1).alias("path"), field(2).cast("long").alias("line"), field(3).alias("text"))


SQL_VIEWS["commits"] = "SELECT o_orderkey AS revision, c_name AS author, CAST(o_orderdate AS DATE) AS day, o_orderpriority || ' ' || o_orderstatus AS message FROM orders JOIN customer ON c_custkey = o_custkey"
SQL_VIEWS["diffs"] = "SELECT l_orderkey AS revision, 'src/part_' || (l_partkey % 50) || '.py' AS path, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS sign, 'call(' || l_suppkey || ', ' || l_linestatus || ')' AS text FROM lineitem"


def _commits(c: Corpus):
    named = c.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
    return c.table("orders").join(named, "o_custkey").select(F.col("o_orderkey").alias("revision"), "author", F.col("o_orderdate").cast("date").alias("day"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"))


def _diffs(c: Corpus):
    text = F.concat(F.lit("call("), F.col("l_suppkey").cast("string"), F.lit(", "), "l_linestatus", F.lit(")"))
    path = F.concat(F.lit("src/part_"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py"))
    return c.table("lineitem").select(F.col("l_orderkey").alias("revision"), path.alias("path"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("sign"), text.alias("text"))


def _history(name: str, text: str, where: str) -> None:
    query(name, f"SELECT revision, author, message FROM commits WHERE {where}")(
        lambda c: code.history(_commits(c), _diffs(c), code.parse_history(text, TODAY)).select("revision", "author", "message")
    )


_history("git_author_since", 'author:00001 since:1996 until:1997-06', "contains(lower(author), '00001') AND day BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
_history("git_path", "path:part_7.py since:1998", "day >= DATE '1998-01-01' AND revision IN (SELECT revision FROM diffs WHERE contains(path, 'part_7.py'))")
_history("git_added", 'added:"call(7, "', "revision IN (SELECT revision FROM diffs GROUP BY 1 HAVING sum(CASE sign WHEN '-' THEN -1 ELSE 1 END * CAST(contains(text, 'call(7, ') AS INT)) <> 0)")
_history("git_changed", r"changed:call\(1.,.O\)", r"revision IN (SELECT revision FROM diffs WHERE regexp_matches(text, 'call\(1.,.O\)'))")
_history("git_message", "urgent author:0000", "contains(lower(message), 'urgent') AND contains(lower(author), '0000')")
del _history


@query("git_authors", "SELECT author AS value, count(*) AS n FROM commits WHERE starts_with(lower(author), 'customer#0000000') GROUP BY 1 ORDER BY n DESC, value LIMIT 40")
def git_authors(c: Corpus):
    own = _commits(c).filter(F.lower("author").startswith("customer#0000000"))
    return own.groupBy(F.col("author").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(40)


@query("git_tree", "SELECT path, arg_max(revision, (day, revision)) AS revision, count(DISTINCT revision) AS n FROM diffs JOIN commits USING (revision) GROUP BY 1")
def git_tree(c: Corpus):
    met = _diffs(c).select("revision", "path").distinct().join(_commits(c).select("revision", "day"), "revision")
    return met.groupBy("path").agg(F.max_by("revision", F.struct("day", "revision")).alias("revision"), F.count("*").alias("n"))


@query("git_show", "SELECT d.path, d.sign, d.text FROM diffs d WHERE d.revision = (SELECT max(revision) FROM diffs)")
def git_show(c: Corpus):
    last = _diffs(c).agg(F.max("revision").alias("revision"))
    return _diffs(c).join(F.broadcast(last), "revision").select("path", "sign", "text")


@query("repo_registry", "SELECT root_path, max(name) AS name, max(seen) AS last_seen FROM (SELECT root_path, name, 100 AS seen FROM repos UNION ALL SELECT '/corpus/' || source, 'repo_' || substr(source, 4), max(doc_id) FROM documents GROUP BY source) GROUP BY 1")
def repo_registry(c: Corpus):
    seen = c.table("documents").groupBy("source").agg(F.max("doc_id").alias("seen")).select(F.concat(F.lit("/corpus/"), "source").alias("root_path"), F.concat(F.lit("repo_"), F.expr("substring(source, 4)")).alias("name"), "seen")
    known = c.repos.select("root_path", "name", F.lit(100).cast("long").alias("seen"))
    return known.unionByName(seen).groupBy("root_path").agg(F.max("name").alias("name"), F.max("seen").alias("last_seen"))


# ---- answers

CITED = "SELECT b.item_id, d.doc_id, b.text AS passage, d.text AS evidence FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 40))"
NUMBERS = "list_distinct(list_transform(regexp_extract_all(%s, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')))"
WORDS_OF = f"list_distinct(list_filter(regexp_split_to_array(lower(%s), {BREAK}), lambda w: w <> ''))"
NEGATED = f"regexp_matches(%s, '{answers.NEGATION.replace(chr(39), chr(39) * 2)}')"
CLAIMS = f"SELECT item_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN passage ELSE passage || ' 987654 unsupported words that nobody wrote at all anywhere here' END AS sentence, evidence FROM ({CITED})"


def _claims(c: Corpus):
    asked = c.table("benchmark").select("item_id", F.col("text").alias("passage"), F.substring("text", 1, 40).alias("start"))
    out = None
    for block in vectors.blocks(asked, "item_id"):
        met = c.table("documents").join(F.broadcast(block), F.col("text").contains(F.col("start")))
        out = met if out is None else out.unionByName(met)
    more = F.concat("passage", F.lit(" 987654 unsupported words that nobody wrote at all anywhere here"))
    return out.select("item_id", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("passage")).otherwise(more).alias("sentence"), F.col("text").alias("evidence"))


@query("answer_support", f"SELECT item_id, doc_id, round(s, 6) AS support, n >= 2 AND s >= 0.7 AND g AND a AS accepted FROM (SELECT item_id, doc_id, len({WORDS_OF % 'sentence'}) AS n, CAST(len(list_intersect({WORDS_OF % 'sentence'}, {WORDS_OF % 'evidence'})) AS DOUBLE) / greatest(len({WORDS_OF % 'sentence'}), 1) AS s, list_has_all({NUMBERS % 'evidence'}, {NUMBERS % 'sentence'}) AS g, {NEGATED % 'sentence'} = {NEGATED % 'evidence'} AS a FROM ({CLAIMS}))")
def answer_support(c: Corpus):
    return answers.verdicts(_claims(c)).select("item_id", "doc_id", "support", "accepted")


@query("answer_reconciled", f"SELECT item_id, md5(coalesce(string_agg(sentence, ' ' ORDER BY doc_id) FILTER (ok), '')) AS answer, count_if(NOT ok) AS dropped FROM (SELECT item_id, doc_id, sentence, len({WORDS_OF % 'sentence'}) >= 2 AND CAST(len(list_intersect({WORDS_OF % 'sentence'}, {WORDS_OF % 'evidence'})) AS DOUBLE) / greatest(len({WORDS_OF % 'sentence'}), 1) >= 0.7 AND list_has_all({NUMBERS % 'evidence'}, {NUMBERS % 'sentence'}) AND {NEGATED % 'sentence'} = {NEGATED % 'evidence'} AS ok FROM ({CLAIMS})) GROUP BY 1")
def answer_reconciled(c: Corpus):
    out = answers.reconciled(answers.verdicts(_claims(c)), "item_id", "doc_id")
    return out.select("item_id", F.md5(F.col("answer").cast("binary")).alias("answer"), "dropped")


PIECES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(%s, '([.!?…]["'')\]]*)[ \t\r\n]+|\n[ \t\r]*\n', '\1' || chr(1), 'g'), '((?:[^ \t\r\n\x01]+[ \t\r\n]+){60})', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"""
STEMMED = f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower(%s), {BREAK}), lambda w: w <> ''), lambda w: regexp_replace(w, '^(.{{3,}}?)(?:ing|ed|es|ly|s)$', '\\1')))"
SAME_MONTHS = " AND ".join(f"(NOT regexp_matches(s, '{n}') OR regexp_matches(t, '{n}') OR regexp_matches(t, '{d}'))" for n, d in answers.MONTH_FORMS)
PLAIN = "regexp_replace(regexp_replace(%s, '[“”„«»]', '\"', 'g'), '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')"
#: A document is cited by an item that it shares a sentence of this many characters with.
LEAST_CITED = 20
ALIGNED = f"""
WITH b AS (SELECT item_id, unnest({PIECES % 'text'}) AS s, generate_subscripts({PIECES % 'text'}, 1) AS n FROM benchmark),
d AS (SELECT doc_id, {PIECES % 'text'} AS p FROM documents),
cited AS (SELECT DISTINCT item_id, doc_id FROM (SELECT doc_id, unnest(p) AS s FROM d) JOIN b USING (s) WHERE length(s) >= {LEAST_CITED}),
claims AS (SELECT item_id, doc_id, CAST(n AS INT) AS n, CASE doc_id % 4 WHEN 1 THEN s || ' It is never so.' WHEN 2 THEN s || ' 987654' WHEN 3 THEN s || ' of Xanthippe' ELSE s END AS s FROM cited JOIN b USING (item_id)),
wanted AS (SELECT *, {STEMMED % 's'} AS w FROM claims),
windows AS (SELECT doc_id, i, k, array_to_string(p[i:i + k - 1], ' ') AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM cited)) CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE i + k - 1 <= len(p)),
stemmed AS (SELECT *, {STEMMED % 't'} AS q FROM windows),
best AS (SELECT item_id, doc_id, n, s, w, t, len(list_intersect(w, q)) AS have FROM wanted JOIN stemmed USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, doc_id, n ORDER BY len(list_intersect(w, q)) DESC, length(t), i, k) = 1),
told AS (SELECT *, CASE WHEN len(w) < 2 THEN 'too little' WHEN have / greatest(len(w), 1) < 0.7 THEN 'unsupported' WHEN {NEGATED % 's'} <> {NEGATED % 't'} THEN 'negation' WHEN NOT list_has_all({NUMBERS % 't'}, {NUMBERS % 's'}) THEN 'number' WHEN NOT ({SAME_MONTHS}) THEN 'month' WHEN NOT list_has_all(regexp_split_to_array(lower(t), {BREAK}), list_filter(list_transform(regexp_extract_all(s, '[^\\p{{L}}\\p{{N}}.!?](\\p{{Lu}}\\p{{L}}+)', 1), lambda x: lower(x)), lambda x: x NOT IN {tuple(answers.MONTHS)})) THEN 'name' WHEN len(list_filter(regexp_extract_all({PLAIN % 's'}, '"([^"]*[^" ] [^" ][^"]*)"', 1), lambda x: NOT contains({PLAIN % 't'}, x))) > 0 THEN 'quotation' END AS reason FROM best)
SELECT item_id, doc_id, n, md5(t) AS receipt, round(have / greatest(len(w), 1), 6) AS support, reason IS NULL AS accepted, reason FROM told
""".replace("\\\\", "\\")


@query("answer_aligned", ALIGNED)
def answer_aligned(c: Corpus):
    # Each sentence of a benchmark text, as it is or with something that isn't in the document, against a document that shares a sentence with it.
    pieces = answers.sentences(F.col("text"))
    asked = c.table("benchmark").select("item_id", F.posexplode(pieces).alias("n", "s"))
    long = F.length("s") >= LEAST_CITED
    shared = c.table("documents").select("doc_id", F.explode(pieces).alias("s")).filter(long)
    cited = shared.join(asked.filter(long).select("item_id", "s"), "s").select("item_id", "doc_id").distinct()
    d = F.col("doc_id") % 4
    more = F.when(d == 1, F.concat("s", F.lit(" It is never so."))).when(d == 2, F.concat("s", F.lit(" 987654"))).when(d == 3, F.concat("s", F.lit(" of Xanthippe"))).otherwise(F.col("s"))
    # Documents that are cited are cut once each; claims come to them by their number, and texts aren't moved again.
    evidence = answers.prepared(c.table("documents").select("doc_id", F.col("text").alias("evidence")).join(cited.select("doc_id").distinct(), "doc_id", "left_semi"))
    claims = cited.join(asked, "item_id").select("item_id", "doc_id", (F.col("n") + 1).alias("n"), more.alias("sentence"))
    found = answers.aligned(claims.join(evidence, "doc_id"))
    return found.select("item_id", "doc_id", "n", F.md5(F.col("receipt").cast("binary")).alias("receipt"), "support", "accepted", "reason")


@query("search_coverage", f"SELECT q.qid, round(coalesce(max(CAST(len(list_intersect(q.w, d.w)) AS DOUBLE) / len(q.w)), 0.0), 6) AS coverage, coalesce(max(CAST(len(list_intersect(q.w, d.w)) AS DOUBLE) / len(q.w)), 0.0) < 0.5 AS thin FROM (SELECT qid, list(DISTINCT term) AS w FROM searches GROUP BY 1) q LEFT JOIN ({TOP % (RANKED % SCORES, 3)}) t ON t.qid = q.qid LEFT JOIN ({SETS}) d ON d.doc_id = t.doc_id GROUP BY 1")
def search_coverage(c: Corpus):
    wanted = c.searches.groupBy("qid").agg(F.collect_set("term").alias("words"))
    page = keyword.top(keyword.scores(c, c.searches).select("qid", "doc_id", "score"), 3)
    words = c.table("documents").select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("words"))
    return answers.coverage(wanted, page.join(words, "doc_id").select("qid", "words"))


@query("compare_sides", "SELECT side, lang, count(*) AS n FROM (SELECT 'license' AS side, doc_id FROM postings WHERE term = 'license' UNION ALL SELECT 'token', doc_id FROM postings WHERE term = 'token') JOIN documents USING (doc_id) GROUP BY 1, 2")
def compare_sides(c: Corpus):
    sides = questions.sides_of("compare license and token")
    hits = keyword.counts_of_words(c, sides).select(F.col("term").alias("side"), "doc_id")
    return hits.join(c.table("documents").select("doc_id", "lang"), "doc_id").groupBy("side", "lang").agg(F.count("*").alias("n"))


@query("chat_scores", f"SELECT conv_id, round(avg(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(a.w)), 6) AS score FROM (SELECT conv_id, turn, {WORDS_OF % 'text'} AS w FROM conversations WHERE role = 'user') a JOIN (SELECT conv_id, turn, {WORDS_OF % 'text'} AS w FROM conversations WHERE role = 'assistant') b USING (conv_id) WHERE b.turn = a.turn + 1 AND len(a.w) > 0 GROUP BY 1")
def chat_scores(c: Corpus):
    turns = c.table("conversations").select("conv_id", "turn", "role", F.array_distinct(T.words(F.col("text"))).alias("w"))
    asked = turns.filter("role = 'user' and size(w) > 0").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("q"))
    met = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return met.groupBy("conv_id").agg(F.round(F.avg(F.size(F.array_intersect("q", "w")) / F.size("q")), 6).alias("score"))


@query("glossary_substitute", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\bapache license\b', 'open terms', 'g'), '(?i)\btoken\b', 'key', 'g')) AS h FROM documents")
def glossary_substitute(c: Corpus):
    text = answers.substituted(F.col("text"), {"token": "key", "Apache License": "open terms"})
    return c.table("documents").select("doc_id", F.md5(text.cast("binary")).alias("h"))


@query("saved_search", "SELECT id, path FROM files WHERE ext = 'pdf' AND size_bytes >= 4096")
def saved_search(c: Corpus):
    q = parse("saved:big", TODAY, {"big": "type:pdf saved:size", "size": "size:>=4kb"})
    return filters.apply(c.files, q, c).select("id", "path")
