"""Keyword and vector retrieval, fusion and shaping of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import ivf, keyword, ranking, spelling, vectors
from brindle.plans.grammar import number_forms
from brindle.queries.registry import query
from brindle.sources.corpus import BASE_NS, Corpus

SCORES = """SELECT s.qid, p.doc_id, sum(greatest(ln((t.n - v.df + 0.5) / (v.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / t.mean))) AS score, count(*) AS matched
FROM searches s JOIN postings p ON s.term = p.term JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) v ON v.term = p.term
JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN (SELECT count(*) AS n, avg(len) AS mean FROM lengths) t GROUP BY 1, 2"""
RANKED = "SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (%s)"
TOP = "SELECT * FROM (%s) WHERE rank <= %d"
WANTED = "SELECT qid, count(*) AS wanted FROM searches GROUP BY qid"


def _scores(c: Corpus):
    return keyword.scores(c, c.searches)


@query("bm25_top", TOP % (RANKED % SCORES, 10))
def bm25_top(c: Corpus):
    return keyword.top(_scores(c).select("qid", "doc_id", "score"), 10)


@query("bm25_and", TOP % (RANKED % f"SELECT s.* FROM ({SCORES}) s JOIN ({WANTED}) w ON s.qid = w.qid AND s.matched = w.wanted", 10))
def bm25_and(c: Corpus):
    return keyword.top(keyword.with_all_terms(_scores(c), c.searches).select("qid", "doc_id", "score"), 10)


AND_FIRST = f"SELECT s.qid, s.doc_id, s.score FROM (SELECT r.*, r.matched = w.wanted AS every, count_if(r.matched = w.wanted) OVER (PARTITION BY r.qid) >= 3 AS full_page FROM ({SCORES}) r JOIN ({WANTED}) w ON r.qid = w.qid) s WHERE every OR NOT full_page"


@query("bm25_and_first", TOP % (RANKED % AND_FIRST, 3))
def bm25_and_first(c: Corpus):
    return keyword.and_first(_scores(c), c.searches, 3)


@query("bm25_filtered", TOP % (RANKED % f"SELECT s.* FROM ({SCORES}) s WHERE s.doc_id IN (SELECT id FROM files WHERE ext IN ('txt', 'md') AND status = 'INDEXED')", 10))
def bm25_filtered(c: Corpus):
    allowed = c.files.filter("ext in ('txt', 'md') and status = 'INDEXED'").select(F.col("id").alias("doc_id"))
    return keyword.top(_scores(c).join(allowed, "doc_id", "left_semi").select("qid", "doc_id", "score"), 10)


@query("bm25_not", "SELECT DISTINCT doc_id FROM postings WHERE term = 'the' AND doc_id NOT IN (SELECT doc_id FROM postings WHERE term = 'license')")
def bm25_not(c: Corpus):
    has = lambda w: keyword.counts_of_words(c, [w]).select("doc_id")
    return has("the").join(has("license"), "doc_id", "left_anti").distinct()


@query("bm25_phrase", "SELECT DISTINCT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tokens d ON a.doc_id = d.doc_id AND d.pos = a.pos + 2 WHERE a.term = 'licensed' AND b.term = 'under' AND d.term = 'the'")
def bm25_phrase(c: Corpus):
    return keyword.phrase(c, ["licensed", "under", "the"])


@query("bm25_prefix", "SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM postings WHERE starts_with(term, 'licen') GROUP BY 1")
def bm25_prefix(c: Corpus):
    return keyword.counts_where(c, lambda w: w.startswith("licen"), ["licen"]).groupBy("doc_id").agg(F.sum("tf").alias("tf"))


@query("vocab_df", "SELECT term, count(*) AS df FROM postings GROUP BY term ORDER BY df DESC, term LIMIT 200")
def vocab_df(c: Corpus):
    return c.vocabulary.orderBy(F.desc("df"), "term").limit(200)


@query("common_terms", "SELECT term, df FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN (SELECT count(*) AS n FROM lengths) WHERE df >= 0.1 * n")
def common_terms(c: Corpus):
    n = F.broadcast(c.lengths.agg(F.count("*").alias("n")))
    return c.vocabulary.join(n).filter(F.col("df") >= 0.1 * F.col("n")).select("term", "df")


@query("unmatched_terms", "SELECT DISTINCT qid, s.term FROM searches s WHERE length(s.term) >= 3 AND s.term NOT IN (SELECT term FROM postings)")
def unmatched_terms(c: Corpus):
    return c.searches.filter(F.length("term") >= 3).join(c.vocabulary, "term", "left_anti").select("qid", "term").distinct()


@query("wildcard_expand", "SELECT term, count(*) AS df FROM postings WHERE regexp_matches(term, '^th.*ing$') GROUP BY term ORDER BY df DESC, term LIMIT 200")
def wildcard_expand(c: Corpus):
    return keyword.globbed(c, "th*ing").orderBy(F.desc("df"), "term").limit(200)


SPELL = r"""WITH w AS (SELECT DISTINCT substr(term, 1, length(term) - 1) AS word FROM searches WHERE length(term) >= 6 AND regexp_matches(term, '^[a-z]+$')), v AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
m AS (SELECT w.word, v.term, v.df, levenshtein(w.word, regexp_replace(v.term, '[^\x00-\x7F]', '~', 'g')) AS distance FROM w JOIN v ON v.term <> w.word AND abs(length(v.term) - length(w.word)) <= 2)
SELECT word, term AS suggestion, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS b FROM m WHERE distance <= CASE WHEN length(word) >= 7 THEN 2 ELSE 1 END) WHERE b = 1"""


@query("spelling_suggest", SPELL)
def spelling_suggest(c: Corpus):
    # The SQL engine counts edits in bytes, so there another sign of one byte stands for letters that a-z can't match.
    words = c.searches.filter((F.length("term") >= 6) & F.col("term").rlike("^[a-z]+$")).select(F.expr("substring(term, 1, length(term) - 1)").alias("word")).distinct()
    return spelling.suggestions(c, words)


@query("number_variants", "SELECT doc_id, count(*) AS n FROM tokens WHERE term IN ('5556869', '6869', '2373', '6210') GROUP BY 1")
def number_variants(c: Corpus):
    typed = ["5,556,869", "6,869", "2,373", "6,210"]
    forms = [f for t in typed for f in number_forms(t) if f.isalnum()]
    return keyword.counts_of_words(c, forms).groupBy("doc_id").agg(F.sum("tf").alias("n"))


@query("filename_search", "SELECT id, 10 * CAST(contains(lower(regexp_extract(path, '[^/]*$')), 'doc_1') AS INT) + CAST(contains(lower(parent_dir), 'src1') AS INT) AS score FROM files WHERE contains(lower(regexp_extract(path, '[^/]*$')), 'doc_1') OR contains(lower(parent_dir), 'src1') ORDER BY score DESC, id LIMIT 50")
def filename_search(c: Corpus):
    name, folder = F.lower(T.basename(F.col("path"))).contains("doc_1"), F.lower("parent_dir").contains("src1")
    score = 10 * name.cast("int") + folder.cast("int")
    return c.files.filter(name | folder).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(50)


DOT = "list_sum(list_transform(list_zip(%s, %s), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
COS = f"{DOT % ('a.embedding', 'b.embedding')} / (sqrt({DOT % ('a.embedding', 'a.embedding')}) * sqrt({DOT % ('b.embedding', 'b.embedding')}))"
KNN = f"SELECT qid, id, sim, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round({COS}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND {{keep}}) WHERE rank <= 10"


def _knn(c: Corpus, keep=None):
    e = c.table("embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    pool = e.filter(keep) if keep is not None else e
    return vectors.knn(asked, pool.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


@query("knn_cosine", KNN.format(keep="true"))
def knn_cosine(c: Corpus):
    return _knn(c)


@query("knn_ivf", None)
def knn_ivf(c: Corpus):
    # The cells that a search reads are measured against exact search, so recall is what was asked for.
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return ivf.build(rows).search(asked, 10)


@query("knn_filtered", KNN.format(keep="b.label = 1"))
def knn_filtered(c: Corpus):
    return _knn(c, F.col("label") == 1)


SAME_FILE = KNN.format(keep="a.vec_id // 10 <> b.vec_id // 10")


@query("similar_to", f"SELECT qid, id, rank, round(1.0 / (1 + rank), 6) AS score FROM ({SAME_FILE})")
def similar_to(c: Corpus):
    # Ten vectors are a file's; its own are no answer.
    e = c.table("embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    near = vectors.knn(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10, group=10)
    return near.select("qid", "id", "rank", F.round(1.0 / (1 + F.col("rank")), 6).alias("score"))


SPOILT = "CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: CAST('nan' AS FLOAT)) WHEN vec_id % 70 = 0 THEN [] WHEN vec_id % 90 = 0 THEN NULL ELSE embedding END"


@query("bad_vectors", f"SELECT vec_id FROM (SELECT vec_id, {SPOILT} AS e FROM embeddings) WHERE e IS NULL OR len(e) = 0 OR len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0")
def bad_vectors(c: Corpus):
    e, v = F.col("embedding"), F.col("vec_id")
    spoilt = F.when(v % 50 == 0, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).when(v % 70 == 0, F.array().cast("array<float>")).when(v % 90 == 0, F.lit(None)).otherwise(e)
    return vectors.bad(c.table("embeddings").select("vec_id", spoilt.alias("e")), "vec_id", "e")


@query("unit_vectors", f"SELECT vec_id, unnest(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt({DOT % ('embedding', 'embedding')}), 6))) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings")
def unit_vectors(c: Corpus):
    return c.table("embeddings").select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("centroid", "SELECT label, i - 1 AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def centroid(c: Corpus):
    return vectors.centroids(c.table("embeddings"), "label", "embedding")


@query("vector_coverage", "SELECT round(c, 6) AS coverage, c >= 0.95 AS ready FROM (SELECT least(1.0, (SELECT count(*) FROM embeddings) / (SELECT count(*) FROM files WHERE status <> 'NAME_ONLY')) AS c)")
def vector_coverage(c: Corpus):
    # Files known by name alone have no passages to embed.
    v = c.table("embeddings").agg(F.count("*").alias("v"))
    share = F.least(F.lit(1.0), F.col("v") / F.col("n"))
    return c.files.filter("status != 'NAME_ONLY'").agg(F.count("*").alias("n")).join(F.broadcast(v)).select(F.round(share, 6).alias("coverage"), (share >= 0.95).alias("ready"))


@query("frame_best", f"SELECT qid, file, arg_max(id, (sim, -id)) AS id, max(sim) AS sim FROM (SELECT qid, id // 10 AS file, id, sim FROM ({KNN.format(keep='true')})) GROUP BY 1, 2")
def frame_best(c: Corpus):
    hits = _knn(c).withColumn("file", F.floor(F.col("id") / 10))
    return hits.groupBy("qid", "file").agg(F.max_by("id", F.struct("sim", -F.col("id"))).alias("id"), F.max("sim").alias("sim"))


LANE_A = f"SELECT qid, doc_id AS id, rank FROM ({TOP % (RANKED % SCORES, 20)})"
LANE_B = "SELECT s.qid, p.doc_id AS id, row_number() OVER (PARTITION BY s.qid ORDER BY sum(p.tf) DESC, p.doc_id) AS rank FROM searches s JOIN postings p ON s.term = p.term GROUP BY s.qid, p.doc_id QUALIFY rank <= 20"
FUSED = f"SELECT qid, id, round(sum(part), 9) AS rrf, min((rank, list)) AS first, string_agg(name, '+' ORDER BY name) AS sources FROM (SELECT qid, id, rank, 0 AS list, 'keyword' AS name, 1.0 / (60 + rank) AS part FROM ({LANE_A}) UNION ALL SELECT qid, id, rank, 1, 'words', 1.0 / (60 + rank) FROM ({LANE_B})) GROUP BY 1, 2"
PLACED = f"SELECT qid, id, rrf, sources, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, id) AS place FROM ({FUSED})) WHERE place <= 20"


def _fused(c: Corpus):
    first = keyword.top(_scores(c).select("qid", "doc_id", "score"), 20).select("qid", F.col("doc_id").alias("id"), "rank")
    second = keyword.top(keyword.counts(c, c.searches), 20).select("qid", F.col("doc_id").alias("id"), "rank")
    return ranking.placed(ranking.fuse([("keyword", first), ("words", second)]), 20)


@query("rrf_fuse", PLACED)
def rrf_fuse(c: Corpus):
    return _fused(c).select("qid", "id", "rrf", "sources", "place")


FRESH = f"pow(0.5, (({BASE_NS} - f.mtime_ns) / 86400000000000.0) / 180)"


@query("recency_blend", f"SELECT p.qid, p.id, row_number() OVER (PARTITION BY p.qid ORDER BY round(p.rrf * (1 + 0.03 * {FRESH}), 9) DESC, p.place) AS place FROM ({PLACED}) p JOIN files f ON p.id = f.id")
def recency_blend(c: Corpus):
    hits = _fused(c).select("qid", "id", "rrf", "place").join(c.files.select("id", "mtime_ns"), "id")
    key = F.round(ranking.recency(F.col("rrf"), F.col("mtime_ns"), BASE_NS), 9)
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(key.desc(), "place"))).select("qid", "id", "place")


@query("filename_bonus", f"SELECT p.qid, p.id, round(CASE WHEN regexp_matches(regexp_extract(f.path, '[^/]*$'), '(^|[^a-zA-Z0-9])txt([^a-zA-Z0-9]|$)') THEN p.rrf * 1.05 ELSE p.rrf END, 9) AS score FROM ({PLACED}) p JOIN files f ON p.id = f.id")
def filename_bonus(c: Corpus):
    hits = _fused(c).select("qid", "id", "rrf").join(c.files.select("id", "path"), "id")
    return hits.select("qid", "id", F.round(ranking.filename_bonus(F.col("rrf"), F.col("path"), ["txt"]), 9).alias("score"))


DECLARED = r"(?im)(\b(class|interface|struct|enum|trait|record|union|protocol|namespace|module|type|def|func|fn|function|fun|sub|procedure|const|let|var|val|create +table|create +view|create +index|create +trigger)[ \t]+token\b)|(^[ \t]*\x22?token\x22?[ \t]*(:=?|=)[^=\n])|(\btoken *\([^()\n]*\) *\{)"


@query("declares_boost", f"SELECT doc_id, CASE WHEN regexp_matches(replace(text, ' token = ', chr(10) || 'token = '), '{DECLARED}') THEN CAST(1.4 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS score FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'the')")
def declares_boost(c: Corpus):
    docs = c.table("documents").filter(F.lower("text").contains("token") | F.lower("text").contains("the"))
    lines = F.replace("text", F.lit(" token = "), F.lit("\ntoken = "))
    return docs.select("doc_id", ranking.declaration_bonus(F.lit(1.0), lines, "token").alias("score"))


@query("fold_copies", "SELECT head, position, older FROM (SELECT coalesce(content_hash, '#' || id) AS g, max_by(id, (mtime_ns, -id)) AS head, min(rank) AS position, count(*) - 1 AS older FROM (SELECT id, content_hash, mtime_ns, row_number() OVER (ORDER BY size_bytes DESC, id) AS rank FROM files WHERE ext = 'pdf') GROUP BY 1)")
def fold_copies(c: Corpus):
    pdf = c.files.filter("ext = 'pdf'").select("id", "content_hash", "mtime_ns", "size_bytes")
    return ranking.fold_copies(ranking.positions(pdf, F.desc("size_bytes"), F.asc("id")))


MARKED = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')),
 '(^|[ _.-])([0-9]{4}[-_][0-9]{2}[-_][0-9]{2}|[0-9]{2}[-_][0-9]{2}[-_][0-9]{2,4})', '\1 @', 'g'), '[(\[] *[0-9]{1,3} *[)\]]', ' @', 'g'), '(^|[ _.-])v *[0-9]+([._][0-9]+)*', '\1 @', 'g'), '(^|[ _.-])rev(ision)? *[0-9]+', '\1 @', 'g'), '[ _.-]+'), lambda w: w <> '')"""
VERSIONS = "('final', 'draft', 'copy', 'old', 'new', 'latest', 'current', 'rev', 'revision', '@')"
RENAMED = "SELECT id, replace(path, '.', CASE id % 6 WHEN 0 THEN '_v2.1.' WHEN 1 THEN ' (1).' WHEN 2 THEN '_final_draft.' WHEN 3 THEN '-2024-01-05 copy.' WHEN 4 THEN '_semifinal.' ELSE '.' END) AS path FROM files"


@query("version_family", f"SELECT id, array_to_string(w[1:coalesce(list_max(list_transform(w, lambda x, i: CASE WHEN x IN {VERSIONS} THEN 1 ELSE i END)), 1)], ' ') AS family, coalesce(w[-1] IN {VERSIONS}, false) AS marked FROM (SELECT id, {MARKED} AS w FROM ({RENAMED}))")
def version_family(c: Corpus):
    i = F.col("id") % 6
    mark = F.when(i == 0, "_v2.1.").when(i == 1, " (1).").when(i == 2, "_final_draft.").when(i == 3, "-2024-01-05 copy.").when(i == 4, "_semifinal.").otherwise(".")
    named = c.files.select("id", F.replace("path", F.lit("."), mark).alias("path"))
    return named.select("id", T.version_family(F.col("path")).alias("family"), T.has_version_mark(F.col("path")).alias("marked"))


CHUNK_HITS = "SELECT s.qid, c.file_id, c.id AS chunk_id, row_number() OVER (PARTITION BY s.qid ORDER BY count(*) DESC, c.id) AS rank FROM (SELECT DISTINCT qid, term FROM searches) s JOIN (SELECT DISTINCT id, file_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM chunks) c ON s.term = c.term GROUP BY 1, 2, 3"


@query("group_by_document", f"SELECT qid, file_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY r, file_id) AS rank FROM (SELECT qid, file_id, min(rank) AS r, arg_min(chunk_id, rank) AS chunk_id FROM (SELECT * FROM ({CHUNK_HITS}) WHERE rank <= 200) GROUP BY 1, 2)")
def group_by_document(c: Corpus):
    words = c.chunks.select("id", "file_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    found = c.searches.join(words, "term").groupBy("qid", "file_id", F.col("id").alias("chunk_id")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "chunk_id"))
    return ranking.by_document(found.withColumn("rank", rank).filter("rank <= 200"))


@query("recall_at_k", f"SELECT round(avg(hit), 6) AS recall FROM (SELECT q.qid, max(CASE WHEN t.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit FROM (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) q LEFT JOIN ({TOP % (RANKED % SCORES, 10)}) t ON q.qid = t.qid AND q.doc_id = t.doc_id GROUP BY q.qid)")
def recall_at_k(c: Corpus):
    # Every document is searched for each passage, a block of passages at a time.
    passages = c.table("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    holds = F.col("text").contains(F.col("passage"))
    met = [c.table("documents").join(F.broadcast(b), holds).select("qid", "doc_id") for b in vectors.blocks(passages, "qid")]
    right = reduce(DataFrame.unionByName, met)
    found = bm25_top(c).select("qid", "doc_id", F.lit(1.0).alias("found"))
    hit = right.join(found, ["qid", "doc_id"], "left").groupBy("qid").agg(F.max(F.coalesce("found", F.lit(0.0))).alias("hit"))
    return hit.agg(F.round(F.avg("hit"), 6).alias("recall"))
