"""Mail, contacts, changes, streams, pictures, graphs, code and conversation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import changes, faces, graphs, passages
from brindle.queries.registry import query
from brindle.sources.corpus import BASE_NS, DAY_NS, Corpus
from brindle.streaming import windows

# ---- mail


@query("mail_browse", "SELECT file_id, subject, sent_at FROM messages WHERE sender = 'user@example.com' AND (sent_at IS NULL OR sent_at >= 1704067200) ORDER BY sent_at DESC NULLS LAST, file_id LIMIT 50")
def mail_browse(c: Corpus):
    rows = c.messages.filter("sender = 'user@example.com' and (sent_at is null or sent_at >= 1704067200)")
    return rows.select("file_id", "subject", "sent_at").orderBy(F.col("sent_at").desc_nulls_last(), "file_id").limit(50)


@query("mail_to", "SELECT file_id FROM messages WHERE list_contains(recipients, 'user@example.com')")
def mail_to(c: Corpus):
    return c.messages.filter(F.array_contains("recipients", "user@example.com")).select("file_id")


@query("filter_has_attach", "SELECT file_id FROM messages WHERE has_attach")
def filter_has_attach(c: Corpus):
    return c.messages.filter("has_attach").select("file_id")


@query("value_counts_sender", "SELECT sender AS value, count(*) AS n, max(sent_at) AS newest FROM messages GROUP BY 1")
def value_counts_sender(c: Corpus):
    return c.messages.groupBy(F.col("sender").alias("value")).agg(F.count("*").alias("n"), F.max("sent_at").alias("newest"))


@query("contact_activity", "SELECT address, count_if(way = 'from') AS n_from, count_if(way = 'to') AS n_to, min(sent_at) AS first, max(sent_at) AS last FROM (SELECT sender AS address, 'from' AS way, sent_at FROM messages UNION ALL SELECT unnest(recipients), 'to', sent_at FROM messages) GROUP BY 1")
def contact_activity(c: Corpus):
    sent = c.messages.select(F.col("sender").alias("address"), F.lit("from").alias("way"), "sent_at")
    got = c.messages.select(F.explode("recipients").alias("address"), F.lit("to").alias("way"), "sent_at")
    return sent.unionByName(got).groupBy("address").agg(
        F.count_if(F.col("way") == "from").alias("n_from"), F.count_if(F.col("way") == "to").alias("n_to"), F.min("sent_at").alias("first"), F.max("sent_at").alias("last")
    )


@query("mail_archives", "SELECT conversation % 10 AS archive, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT sender) AS senders FROM messages GROUP BY 1")
def mail_archives(c: Corpus):
    return c.messages.groupBy((F.col("conversation") % 10).alias("archive")).agg(
        F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.countDistinct("sender").alias("senders")
    )


@query("conversation_pack", "SELECT conversation, turn, spent FROM (SELECT conversation, turn, CAST(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conversation ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM messages) WHERE spent <= 300")
def conversation_pack(c: Corpus):
    costs = c.messages.select("conversation", "turn", F.ceil(F.length("text") / 4.0).alias("cost"))
    return graphs.running_budget(costs, 300).select("conversation", "turn", "spent")


# ---- contacts


@query("contact_dupes_edges", "SELECT email, count(*) AS n, min(id) AS first_id FROM contacts GROUP BY 1 HAVING count(*) > 1")
def contact_dupes_edges(c: Corpus):
    return c.contacts.groupBy("email").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query("connected_components", "WITH k AS (SELECT id, min(id) OVER (PARTITION BY email) AS e, min(id) OVER (PARTITION BY CASE WHEN id % 97 = 0 THEN 'x' || id % 5 ELSE 'i' || id END) AS p FROM contacts), g AS (SELECT e, min(p) AS p FROM k GROUP BY e) SELECT k.id AS node, r.component FROM k JOIN (WITH RECURSIVE w(a, b) AS (SELECT e, e FROM k UNION SELECT w.a, x.b FROM w JOIN (SELECT k1.e AS a, k2.e AS b FROM k k1 JOIN k k2 ON k1.p = k2.p AND k1.e <> k2.e) x ON w.b = x.a) SELECT a, min(b) AS component FROM w GROUP BY a) r ON k.e = r.a WHERE k.id <> r.component OR k.id IN (SELECT e FROM k GROUP BY e HAVING count(*) > 1) OR k.id % 97 = 0")
def connected_components(c: Corpus):
    # Links to the first of each key, not all pairs: same e-mail, or the same of five numbers.
    phone = F.when(F.col("id") % 97 == 0, F.concat(F.lit("x"), (F.col("id") % 5).cast("string")))
    edges = None
    for key in (F.col("email"), phone):
        rows = c.contacts.select("id", key.alias("k")).filter("k is not null")
        own = rows.join(rows.groupBy("k").agg(F.min("id").alias("b")), "k").select(F.col("id").alias("a"), "b")
        edges = own if edges is None else edges.unionByName(own)
    found = graphs.components(edges)
    several = c.contacts.groupBy("email").agg(F.min("id").alias("node"), F.count("*").alias("n")).filter("n > 1").select("node", F.lit(True).alias("head"))
    return found.join(several, "node", "left").filter(F.col("head") | (F.col("node") != F.col("component")) | (F.col("node") % 97 == 0)).select("node", "component")


@query("smart_group_rules", "SELECT id FROM contacts WHERE company <> 'SUPPLY' AND contains(lower(name), 'customer') AND email IS NOT NULL AND company = 'BUILDING'")
def smart_group_rules(c: Corpus):
    rules = [("company", "is_not", "SUPPLY"), ("name", "contains", "customer"), ("email", "not_empty", None), ("company", "is", "BUILDING")]
    test = {
        "is": lambda f, v: F.col(f) == v, "is_not": lambda f, v: F.col(f) != v, "contains": lambda f, v: T.contains_ci(F.col(f), v),
        "not_empty": lambda f, v: F.col(f).isNotNull() & (F.col(f) != ""), "empty": lambda f, v: F.col(f).isNull() | (F.col(f) == ""),
    }
    every = F.lit(True)
    for field, op, value in rules:
        every = every & test[op](field, value)
    return c.contacts.filter(every).select("id")


@query("contact_search", "SELECT id FROM contacts WHERE len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: starts_with(w, 'cust'))) > 0 AND len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: starts_with(w, '00000001'))) > 0")
def contact_search(c: Corpus):
    parts = F.split(F.lower("name"), "[^a-z0-9]+")
    return c.contacts.filter(F.exists(parts, lambda w: w.startswith("cust")) & F.exists(parts, lambda w: w.startswith("00000001"))).select("id")


@query("domain_statistics", "SELECT split_part(email, '@', 2) AS domain, count(*) AS n FROM contacts GROUP BY 1")
def domain_statistics(c: Corpus):
    return c.contacts.groupBy(F.substring_index("email", "@", -1).alias("domain")).agg(F.count("*").alias("n"))


# ---- changes and streams

OLD = "SELECT id, mtime_ns, size_bytes, content_hash FROM files WHERE id % 19 <> 0"
NEW = f"SELECT id, CASE WHEN id % 11 = 0 THEN mtime_ns + {DAY_NS} ELSE mtime_ns END AS mtime_ns, size_bytes, CASE WHEN id % 13 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM files WHERE id % 17 <> 0"


def _listings(c: Corpus):
    old = c.files.filter("id % 19 != 0").select("id", "mtime_ns", "size_bytes", "content_hash")
    new = c.files.filter("id % 17 != 0").select(
        "id", F.when(F.col("id") % 11 == 0, F.col("mtime_ns") + DAY_NS).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "size_bytes",
        F.when(F.col("id") % 13 == 0, "new").otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return old, new


@query("change_detect", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.mtime_ns = n.mtime_ns AND o.size_bytes = n.size_bytes THEN 'same' WHEN o.content_hash = n.content_hash THEN 'touched' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id")
def change_detect(c: Corpus):
    return changes.detect(*_listings(c))


@query("upsert_merge", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.mtime_ns ELSE o.mtime_ns END AS mtime_ns, CASE WHEN n.id IS NOT NULL THEN n.size_bytes ELSE o.size_bytes END AS size_bytes, coalesce(n.content_hash, o.content_hash) AS content_hash FROM o FULL JOIN n ON o.id = n.id")
def upsert_merge(c: Corpus):
    old, new = _listings(c)
    return changes.upsert(old, new, "id", ["content_hash"])


@query("insert_if_absent", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT id FROM o UNION ALL SELECT id FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_if_absent(c: Corpus):
    old, new = _listings(c)
    return old.select("id").unionByName(new.select("id").join(old.select("id"), "id", "left_anti"))


NEW_CHUNKS = "SELECT id, file_id, ordinal + 1 AS ordinal, CASE WHEN id % 7 = 0 THEN text || ' changed' ELSE text END AS text FROM chunks WHERE id % 11 <> 0"


@query("replace_passages", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY file_id, md5(text) ORDER BY ordinal) AS nth FROM chunks), n AS (SELECT *, row_number() OVER (PARTITION BY file_id, md5(text) ORDER BY ordinal) AS nth FROM ({NEW_CHUNKS})) SELECT coalesce(o.file_id, n.file_id) AS file_id, o.id AS old_id, coalesce(n.ordinal, o.ordinal) AS ordinal, CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.file_id = n.file_id AND o.text = n.text AND o.nth = n.nth")
def replace_passages(c: Corpus):
    changed = F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    new = c.chunks.filter("id % 11 != 0").select("id", "file_id", (F.col("ordinal") + 1).alias("ordinal"), changed.alias("text"))
    return changes.replace_passages(c.chunks, new)


@query("moved_files", "WITH g AS (SELECT id, size_bytes, content_hash, row_number() OVER (PARTITION BY size_bytes, content_hash ORDER BY id) AS nth FROM files WHERE id % 2 = 0 AND content_hash IS NOT NULL), n AS (SELECT id, size_bytes, content_hash, row_number() OVER (PARTITION BY size_bytes, content_hash ORDER BY id) AS nth FROM (SELECT id + 1000000 AS id, size_bytes, content_hash FROM files WHERE id % 3 = 0 AND content_hash IS NOT NULL)) SELECT g.id AS old_id, n.id AS new_id FROM g JOIN n USING (size_bytes, content_hash, nth)")
def moved_files(c: Corpus):
    new = c.files.filter("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), "size_bytes", "content_hash")
    return changes.moves(c.files.filter("id % 2 = 0").select("id", "size_bytes", "content_hash"), new)


@query("three_way_merge", "SELECT key, CASE WHEN l IS NOT DISTINCT FROM r THEN r WHEN b IS NOT DISTINCT FROM l THEN r WHEN b IS NOT DISTINCT FROM r THEN l ELSE r END AS value, CASE WHEN l IS NOT DISTINCT FROM r THEN 'agreed' WHEN b IS NOT DISTINCT FROM l THEN 'remote' WHEN b IS NOT DISTINCT FROM r THEN 'local' ELSE 'conflict' END AS outcome FROM (SELECT c_custkey AS key, c_name AS b, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' L' ELSE c_name END AS l, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' R' ELSE c_name END AS r FROM customer)")
def three_way_merge(c: Corpus):
    rows = c.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    edit = lambda n, mark: rows.withColumn("value", F.when(F.col("key") % n == 0, F.concat("value", F.lit(mark))).otherwise(F.col("value")))
    return changes.three_way(rows, edit(5, " L"), edit(7, " R"), "key")


BURSTS = "WITH e AS (SELECT 'user_' || user_id AS path, epoch(ts) AS t, event_id FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY path ORDER BY t, event_id) AS gap FROM e), i AS (SELECT *, sum(CASE WHEN gap < 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g), a AS (SELECT *, floor((t - min(t) OVER (PARTITION BY path, island)) / 14400) AS slice FROM i) SELECT path, round(min(t), 3) AS first, round(max(t), 3) AS last, count(*) AS n FROM a GROUP BY path, island, slice"


@query("debounce_sessions", BURSTS)
def debounce_sessions(c: Corpus):
    # The events are hours apart, so the pauses are scaled: an hour's quiet, four hours at most.
    events = c.table("events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    out = changes.debounced(events, 3600, 14400)
    return out.select("path", *[F.round(F.col(x).cast("double"), 3).alias(x) for x in ("first", "last")], "n")


@query("overflow_rescan", "SELECT user_id % 10 AS root, count(DISTINCT user_id) AS paths, count(DISTINCT user_id) > 3 AS rescan FROM events GROUP BY 1")
def overflow_rescan(c: Corpus):
    n = F.countDistinct("user_id")
    return c.table("events").groupBy((F.col("user_id") % 10).alias("root")).agg(n.alias("paths"), (n > 3).alias("rescan"))


@query("stream_tumbling", "SELECT epoch(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(c: Corpus):
    return windows.tumbling(windows.timed(c.table("events")), "1 day").withColumn("start", F.col("start").cast("double"))


@query("stream_session", "SELECT user_id, min(t) AS start, count(*) AS n FROM (SELECT user_id, t, sum(CASE WHEN gap < 7200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def stream_session(c: Corpus):
    return windows.sessions(windows.timed(c.table("events")), "2 hours").withColumn("start", F.col("start").cast("double"))


@query("event_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def event_props(c: Corpus):
    return c.table("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("embedding_backlog", "SELECT file_id, count(*) AS waiting FROM chunks WHERE file_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def embedding_backlog(c: Corpus):
    done = c.table("embeddings").select(F.col("vec_id").alias("file_id"))
    return c.chunks.select("file_id").join(done, "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("waiting"))


@query("twin_reuse", "SELECT f.id, t.twin FROM files f JOIN (SELECT content_hash, min(id) AS twin FROM files WHERE id % 3 = 0 AND content_hash IS NOT NULL GROUP BY 1) t ON f.content_hash = t.content_hash WHERE f.id % 3 <> 0")
def twin_reuse(c: Corpus):
    done = c.files.filter("id % 3 = 0 and content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("twin"))
    return c.files.filter("id % 3 != 0").select("id", "content_hash").join(done, "content_hash").select("id", "twin")


# ---- pictures and faces

# ---- text, code, graph

MENTIONS = "SELECT DISTINCT doc_id AS chunk, term AS entity FROM tokens WHERE length(term) >= 9 AND term IN (SELECT term FROM postings GROUP BY term HAVING count(*) BETWEEN 5 AND 50)"


@query("entity_cooccurrence_pmi", f"WITH m AS ({MENTIONS}), s AS (SELECT entity, count(*) AS k FROM m GROUP BY 1), n AS (SELECT count(DISTINCT chunk) AS n FROM m) SELECT x, y, weight, round(log2(n * weight / (kx * ky)), 6) AS pmi FROM (SELECT a.entity AS x, b.entity AS y, count(*) AS weight FROM m a JOIN m b ON a.chunk = b.chunk AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 3) p JOIN (SELECT entity AS x, k AS kx FROM s) USING (x) JOIN (SELECT entity AS y, k AS ky FROM s) USING (y) CROSS JOIN n")
def entity_cooccurrence_pmi(c: Corpus):
    known = c.postings.groupBy("term").agg(F.count("*").alias("n")).filter("n between 5 and 50").select("term")
    mentions = c.postings.filter(F.length("term") >= 9).join(known, "term", "left_semi").select(F.col("doc_id").alias("chunk"), F.col("term").alias("entity"))
    return graphs.co_occurrence(mentions, 3)


@query("token_cost", "SELECT doc_id, round(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: greatest(1.35, length(w) / 4.0))), 4) AS cost FROM documents".replace("\\\\", "\\"))
def token_cost(c: Corpus):
    # Rounded as SQL does: the sums of texts of over a million words can lie halfway.
    return c.table("documents").select("doc_id", (F.round(T.token_cost(F.col("text")) * 10000) / 10000).alias("cost"))


@query("identifier_split", r"SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: length(w) >= 2) AS parts FROM (SELECT p_partkey, 'getHTTPName' || p_partkey || '_' || p_brand AS n FROM part)")
def identifier_split(c: Corpus):
    name = F.concat(F.lit("getHTTPName"), F.col("p_partkey").cast("string"), F.lit("_"), "p_brand")
    return c.table("part").select("p_partkey", T.identifier_parts(name).alias("parts"))


@query("code_browse", "SELECT f.id, r.name, f.path FROM files f JOIN repos r ON f.repo_id = r.id ORDER BY f.mtime_ns DESC, f.id LIMIT 100")
def code_browse(c: Corpus):
    named = c.repos.select(F.col("id").alias("repo_id"), "name")
    return c.files.join(named, "repo_id").orderBy(F.desc("mtime_ns"), "id").limit(100).select("id", "name", "path")


@query("repo_attribution", "SELECT f.id, max_by(r.name, length(r.root_path)) AS repo FROM files f JOIN repos r ON starts_with(f.path, r.root_path || '/') GROUP BY 1")
def repo_attribution(c: Corpus):
    # Longest-prefix match as an equi-join on every ancestor folder of a path.
    parts = F.split("parent_dir", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    roots = c.repos.select(F.col("root_path").alias("root"), F.col("name").alias("repo"))
    return c.files.select("id", F.explode(above).alias("root")).join(roots, "root").groupBy("id").agg(F.max_by("repo", F.length("root")).alias("repo"))


@query("year_hint", r"SELECT id, CAST(nullif(regexp_extract(p, '(^|[^0-9])((18|19|20)[0-9]{2})([^0-9]|$)', 2), '') AS INT) AS year FROM (SELECT id, parent_dir || '/' || (1990 + id % 40) || '/x.jpg' AS p FROM files)")
def year_hint(c: Corpus):
    path = F.concat("parent_dir", F.lit("/"), (1990 + F.col("id") % 40).cast("string"), F.lit("/x.jpg"))
    return c.files.select("id", T.year_hint(path).alias("year"))


@query("rate_drift", f"SELECT source, abs(n - o) / o > 0.3 AS drifted FROM (SELECT source, count_if(mtime_ns < {BASE_NS - 500 * DAY_NS}) AS o, count_if(mtime_ns >= {BASE_NS - 500 * DAY_NS}) AS n FROM files GROUP BY 1) WHERE o > 0")
def rate_drift(c: Corpus):
    old = F.col("mtime_ns") < BASE_NS - 500 * DAY_NS
    counts = c.files.groupBy("source").agg(F.count_if(old).alias("o"), F.count_if(~old).alias("n")).filter("o > 0")
    return counts.select("source", (F.abs(F.col("n") - F.col("o")) / F.col("o") > 0.3).alias("drifted"))


# ---- passages, faces, answers


@query("chunk_passages", None)
def chunk_passages(c: Corpus):
    return passages.chunk(c.table("documents").select("doc_id", "text")).select("doc_id", "ordinal", "start", "end")


@query("chunk_lines", "SELECT file_id, ordinal, length(text) AS n FROM chunks")
def chunk_lines(c: Corpus):
    return c.chunks.select("file_id", "ordinal", F.length("text").alias("n"))


@query("rerank_window", None)
def rerank_window(c: Corpus):
    docs = c.table("documents").filter(F.lower("text").contains("license"))
    return docs.select("doc_id", passages.windows(F.col("text"), ["license", "version"], 600).alias("window"))


@query("stemmed_postings", None)
def stemmed_postings(c: Corpus):
    # Distinct words are stemmed, and joined to the postings.
    stems = passages.stems(c.vocabulary.select("term"))
    return c.postings.select("term", "doc_id").join(stems, "term").groupBy("stem").agg(F.countDistinct("doc_id").alias("df"))


MEANS = "SELECT label AS pile, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 < 3) GROUP BY 1, 2) GROUP BY 1"
SIM = "list_sum(list_transform(list_zip(f.embedding, p.c), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(f.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(p.c, lambda x: x * x))))"


@query("face_piles", f"SELECT face, pile, sim, CASE WHEN sim >= 0.62 THEN 'assigned' WHEN sim >= 0.45 THEN 'suggested' ELSE 'open' END AS outcome FROM (SELECT f.vec_id AS face, p.pile, round({SIM}, 6) AS sim, row_number() OVER (PARTITION BY f.vec_id ORDER BY round({SIM}, 6) DESC, p.pile) AS r FROM embeddings f CROSS JOIN ({MEANS}) p WHERE f.vec_id % 5 >= 3) WHERE r = 1")
def face_piles(c: Corpus):
    e = c.table("embeddings")
    means = e.filter("vec_id % 5 < 3").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    piles = means.groupBy(F.col("label").alias("pile")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return faces.assign(e.filter("vec_id % 5 >= 3").select(F.col("vec_id").alias("face"), F.col("embedding").alias("v")), piles)


@query("stream_sliding", "SELECT epoch(s) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS s FROM events) GROUP BY 1")
def stream_sliding(c: Corpus):
    return windows.sliding(windows.timed(c.table("events")), "2 days", "1 day").withColumn("start", F.col("start").cast("double"))
