"""Sources, stored rows, tidying, pictures and change streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import tidy
from brindle.plans.grammar import TYPE_GROUPS
from brindle.queries.registry import query
from brindle.sources.corpus import BASE_NS, DAY_NS, Corpus

BASENAME = "regexp_extract(path, '[^/]*$')"

# ---- walking and listing


@query("priority_walk", "SELECT id, path FROM files ORDER BY CASE WHEN starts_with(path, '/corpus/src7/') THEN 0 WHEN starts_with(path, '/corpus/src1/') THEN 1 ELSE 2 END, path LIMIT 200")
def priority_walk(c: Corpus):
    # Folders to be indexed first come in the order given.
    first = F.when(F.col("path").startswith("/corpus/src7/"), 0).when(F.col("path").startswith("/corpus/src1/"), 1).otherwise(2)
    return c.files.select("id", "path").orderBy(first, "path").limit(200)


@query("default_exclusions", f"SELECT id, path FROM (SELECT id, CASE id % 6 WHEN 0 THEN '/x/node_modules/' || id || '.py' WHEN 1 THEN '/x/~$' || id || '.docx' WHEN 2 THEN '/x/a' || id || '.tmp' WHEN 3 THEN '/x/.git/' || id ELSE path END AS path FROM files) WHERE NOT regexp_matches(lower(path), '/(node_modules|\\.git|__pycache__|\\.venv|venv)/') AND NOT starts_with({BASENAME}, '~$') AND NOT lower(path) LIKE '%.tmp'")
def default_exclusions(c: Corpus):
    i, s = F.col("id") % 6, F.col("id").cast("string")
    path = F.when(i == 0, F.concat(F.lit("/x/node_modules/"), s, F.lit(".py"))).when(i == 1, F.concat(F.lit("/x/~$"), s, F.lit(".docx"))).when(i == 2, F.concat(F.lit("/x/a"), s, F.lit(".tmp"))).when(i == 3, F.concat(F.lit("/x/.git/"), s)).otherwise(F.col("path"))
    return c.files.select("id", path.alias("path")).filter(~T.excluded(F.col("path")))


@query("repo_detection", "WITH m AS (SELECT DISTINCT regexp_extract(parent_dir, '^/corpus/[^/]*') AS root FROM files WHERE id % 50 = 6) SELECT f.id, max_by(m.root, length(m.root)) AS root FROM files f JOIN m ON f.parent_dir = m.root OR starts_with(f.parent_dir, m.root || '/') GROUP BY 1")
def repo_detection(c: Corpus):
    # A folder above a marker file is a root; each file belongs to the nearest above it, by an equi-join on its ancestors.
    roots = c.files.filter("id % 50 = 6").select(F.regexp_extract("parent_dir", "^/corpus/[^/]*", 0).alias("root")).distinct()
    parts = F.split("parent_dir", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return c.files.select("id", F.explode(above).alias("root")).join(roots, "root").groupBy("id").agg(F.max_by("root", F.length("root")).alias("root"))


@query("known_stamps", "SELECT path, mtime_ns, size_bytes, content_hash FROM files WHERE source_kind = 'file' AND volume_id IS NULL")
def known_stamps(c: Corpus):
    return c.files.filter("source_kind = 'file' and volume_id is null").select("path", "mtime_ns", "size_bytes", "content_hash")


@query("change_detect_recent", f"SELECT id, CASE WHEN mtime_ns < {BASE_NS - 30 * DAY_NS} AND id % 11 <> 0 THEN 'same' WHEN content_hash IS NULL THEN 'changed' WHEN id % 13 = 0 THEN 'changed' ELSE 'same' END AS change FROM files")
def change_detect_recent(c: Corpus):
    # Equal stamps are trusted only for files that weren't touched in the last 30 days; the others' hashes decide.
    now = c.files.select("id", (F.col("mtime_ns") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).alias("stamp"), F.when(F.col("id") % 13 == 0, "new").otherwise(F.col("content_hash")).alias("hash"))
    met = c.files.select("id", "mtime_ns", "content_hash").join(now, "id")
    trusted = (F.col("stamp") == F.col("mtime_ns")) & (F.col("mtime_ns") < BASE_NS - 30 * DAY_NS)
    return met.select("id", F.when(trusted | (F.col("hash") == F.col("content_hash")), "same").otherwise("changed").alias("change"))


@query("corpus_scan_estimate", "SELECT ext, 16 * count(*) AS files, CAST(16 * sum(size_bytes) AS BIGINT) AS bytes FROM files WHERE substr(md5(CAST(id AS VARCHAR)), 1, 1) = '0' GROUP BY 1")
def corpus_scan_estimate(c: Corpus):
    # A sixteenth of all files, chosen by a hash, scaled up.
    some = c.files.filter(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 1) == "0")
    return some.groupBy("ext").agg((16 * F.count("*")).alias("files"), (16 * F.sum("size_bytes")).alias("bytes"))


@query("tier_by_formats", "SELECT f.id, coalesce(t.tier, 'none') AS tier FROM files f LEFT JOIN (VALUES ('pdf', 'extractor'), ('docx', 'extractor'), ('eml', 'extractor'), ('txt', 'text'), ('jpg', 'ocr')) t(ext, tier) ON f.ext = t.ext")
def tier_by_formats(c: Corpus):
    formats = c.spark.createDataFrame([("pdf", "extractor"), ("docx", "extractor"), ("eml", "extractor"), ("txt", "text"), ("jpg", "ocr")], "ext string, tier string")
    return c.files.select("id", "ext").join(formats, "ext", "left").select("id", F.coalesce("tier", F.lit("none")).alias("tier"))


@query("source_families", "SELECT CASE ext WHEN 'docx' THEN 'word' WHEN 'xlsx' THEN 'excel' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'jpg' THEN 'image' WHEN 'eml' THEN 'mail' WHEN 'py' THEN 'code' ELSE 'other' END AS family, count(*) AS n FROM files GROUP BY 1")
def source_families(c: Corpus):
    family = F.create_map(*[F.lit(x) for name, exts in TYPE_GROUPS.items() for e in exts for x in (e, name)])
    return c.files.groupBy(F.coalesce(F.element_at(family, F.col("ext")), F.lit("other")).alias("family")).agg(F.count("*").alias("n"))


@query("volume_catalogue", "SELECT v.name, substr(f.path, 2) AS relative_path, f.size_bytes FROM files f JOIN volumes v ON v.id = f.volume_id WHERE v.kind <> 'network'")
def volume_catalogue(c: Corpus):
    named = c.volumes.filter("kind != 'network'").select(F.col("id").alias("volume_id"), "name")
    return c.files.join(named, "volume_id").select("name", F.expr("substring(path, 2)").alias("relative_path"), "size_bytes")


TOPS = "SELECT volume_id, list_distinct(list(lang || CASE WHEN volume_id = 2 THEN source ELSE '' END)) AS names FROM files WHERE volume_id IS NOT NULL GROUP BY 1"


@query("renamed_source", f"SELECT a, arg_max(b, (jaccard, -b)) AS b, max(jaccard) AS jaccard FROM (SELECT a.volume_id AS a, b.volume_id AS b, len(list_intersect(a.names, b.names)) AS shared, round(CAST(len(list_intersect(a.names, b.names)) AS DOUBLE) / len(list_distinct(list_concat(a.names, b.names))), 6) AS jaccard FROM ({TOPS}) a JOIN ({TOPS}) b ON a.volume_id <> b.volume_id) WHERE shared >= 2 AND jaccard >= 0.6 GROUP BY 1")
def renamed_source(c: Corpus):
    # Volumes are few: three rows meet three rows. The most alike with two names and 0.6 in common is suggested.
    top = F.concat("lang", F.when(F.col("volume_id") == 2, F.col("source")).otherwise(""))
    names = c.files.filter("volume_id is not null").groupBy("volume_id").agg(F.collect_set(top).alias("names"))
    met = names.withColumnRenamed("volume_id", "a").join(names.select(F.col("volume_id").alias("b"), F.col("names").alias("m")), F.col("a") != F.col("b"))
    shared = F.size(F.array_intersect("names", "m"))
    rated = met.select("a", "b", shared.alias("shared"), F.round(shared / F.size(F.array_union("names", "m")), 6).alias("jaccard")).filter("shared >= 2 and jaccard >= 0.6")
    return rated.groupBy("a").agg(F.max_by("b", F.struct("jaccard", -F.col("b"))).alias("b"), F.max("jaccard").alias("jaccard"))


@query("moved_within_volume", "WITH o AS (SELECT volume_id, content_hash, min(path) AS path FROM files WHERE volume_id IS NOT NULL AND content_hash IS NOT NULL AND id % 2 = 0 GROUP BY 1, 2), n AS (SELECT volume_id, content_hash, min('/moved' || path) AS path FROM files WHERE volume_id IS NOT NULL AND content_hash IS NOT NULL AND id % 12 = 0 GROUP BY 1, 2) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'gone' ELSE 'moved' END AS what, n.path AS now FROM o FULL JOIN n ON o.volume_id = n.volume_id AND o.content_hash = n.content_hash")
def moved_within_volume(c: Corpus):
    known = c.files.filter("volume_id is not null and content_hash is not null")
    old = known.filter("id % 2 = 0").groupBy("volume_id", "content_hash").agg(F.min("path").alias("was"))
    new = known.filter("id % 12 = 0").groupBy("volume_id", "content_hash").agg(F.min(F.concat(F.lit("/moved"), "path")).alias("now"))
    what = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "gone").otherwise("moved")
    return old.join(new, ["volume_id", "content_hash"], "full").select(F.coalesce("was", "now").alias("path"), what.alias("what"), "now")


@query("listed_files", "SELECT id, path FROM listing WHERE source_kind = 'file' OR (source_kind IN ('eml', 'msg', 'pst', 'mbox') AND contains(path, '/attachments/'))")
def listed_files(c: Corpus):
    mail = F.col("source_kind").isin("eml", "msg", "pst", "mbox")
    return c.listing.filter((F.col("source_kind") == "file") | (mail & F.col("path").contains("/attachments/"))).select("id", "path")


@query("disk_files_under_root", "SELECT id, path FROM files WHERE source_kind = 'file' AND (path = '/corpus/src3' OR starts_with(path, '/corpus/src3/'))")
def disk_files_under_root(c: Corpus):
    windows = F.regexp_replace("path", "/", r"\\")  # either slash
    return c.files.filter("source_kind = 'file'").filter(T.under_root(windows, "/corpus/src3")).select("id", "path")


@query("containers", "SELECT id, CASE WHEN id % 2 = 0 THEN '/d/box_' || id || '.mbox' ELSE '' END AS box, CASE WHEN id % 2 = 1 THEN '/d/pack.zip' ELSE '' END AS pack FROM files")
def containers(c: Corpus):
    s = F.col("id").cast("string")
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/d/box_"), s, F.lit(".mbox/12"))).otherwise(F.concat(F.lit("/d/pack.zip/in/"), s, F.lit(".txt")))
    inside = lambda kinds: F.regexp_extract("p", rf"(?i)^(.+?\.(?:{kinds}))/.+$", 1)
    return c.files.select("id", path.alias("p")).select("id", inside("mbox|pst|olm").alias("box"), inside("zip|jar|docx").alias("pack"))


@query("dates_in_names", "SELECT id, CASE WHEN id % 2 = 0 THEN CAST(DATE '2015-01-01' + CAST(id % 300 AS INT) AS VARCHAR) END AS day FROM files")
def dates_in_names(c: Corpus):
    day = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") % 300).cast("int")), "yyyyMMdd")
    name = F.concat(F.lit("/p/IMG_"), F.when(F.col("id") % 2 == 0, day).otherwise("12345"), F.lit("_1.jpg"))
    return c.files.select("id", T.day_hint(name).cast("string").alias("day"))


@query("day_words", "SELECT id, strftime(make_timestamp(mtime_ns // 1000), '%d %b %Y') AS day FROM files")
def day_words(c: Corpus):
    return c.files.select("id", T.day_words(F.col("mtime_ns")).alias("day"))


@query("junk_pictures", "SELECT id FROM (SELECT id, id % 160 AS w, (id * 7) % 200 AS h, count(*) OVER (PARTITION BY id % 23) AS seen FROM files WHERE ext = 'jpg') WHERE (w <= 100 AND h <= 100) OR (least(w, h) <= 12 AND greatest(w, h) >= 8 * least(w, h)) OR seen >= 5")
def junk_pictures(c: Corpus):
    # Small, shaped like a divider, or seen five times.
    p = c.files.filter("ext = 'jpg'").select("id", (F.col("id") % 160).alias("w"), (F.col("id") * 7 % 200).alias("h"), (F.col("id") % 23).alias("k"))
    seen = p.groupBy("k").agg(F.count("*").alias("seen"))
    short, long = F.least("w", "h"), F.greatest("w", "h")
    junk = ((F.col("w") <= 100) & (F.col("h") <= 100)) | ((short <= 12) & (long >= 8 * short)) | (F.col("seen") >= 5)
    return p.join(seen, "k").filter(junk).select("id")


# ---- stored rows


@query("vectors_for", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 1)")
def vectors_for(c: Corpus):
    asked = c.table("documents").filter("doc_id % 3 = 1").select(F.col("doc_id").alias("vec_id"))
    return c.table("embeddings").join(asked, "vec_id", "left_semi").select("vec_id", F.size("embedding").alias("dim"))


@query("usage_log", "SELECT user_id AS query, event_type AS kind, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1, 2")
def usage_log(c: Corpus):
    return c.table("events").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("open_counts", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk, count(*) AS opens FROM events WHERE event_type = 'click' GROUP BY 1")
def open_counts(c: Corpus):
    return c.table("events").filter("event_type = 'click'").groupBy(F.get_json_object("props", "$.k").cast("long").alias("chunk")).agg(F.count("*").alias("opens"))


@query("json_result", "SELECT id, to_json({'id': id, 'path': path, 'ext': ext}) AS hit FROM files WHERE ext = 'md'")
def json_result(c: Corpus):
    return c.files.filter("ext = 'md'").select("id", F.to_json(F.struct("id", "path", "ext")).alias("hit"))


@query("completions", "SELECT kind, to_json(list(value ORDER BY n DESC, value)) AS menu FROM (SELECT 'ext' AS kind, ext AS value, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'folder', parent_dir, count(*) FROM files GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, parent_dir) <= 50) GROUP BY 1")
def completions(c: Corpus):
    top = lambda kind, column: c.files.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(50).withColumn("kind", F.lit(kind))
    rows = top("ext", "ext").unionByName(top("folder", "parent_dir"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))), lambda x: x["value"])
    return rows.groupBy("kind").agg(F.to_json(ordered).alias("menu"))


@query("index_summary", "SELECT source_kind, count(*) AS n, count_if(status = 'INDEXED') AS indexed FROM listing GROUP BY 1")
def index_summary(c: Corpus):
    return c.listing.groupBy("source_kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "INDEXED").alias("indexed"))


@query("side_counts_all", "SELECT 'folder' AS side, parent_dir AS value, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'drive', v.name, count(f.id) FROM volumes v LEFT JOIN files f ON f.volume_id = v.id GROUP BY 2 UNION ALL SELECT 'repo', r.name, count(f.id) FROM repos r LEFT JOIN files f ON f.repo_id = r.id GROUP BY 2")
def side_counts_all(c: Corpus):
    own = lambda side, column: c.files.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "value", "n")
    # Counts first: names are joined to a row each.
    of = lambda side, names, key: names.select(F.col("id").alias(key), "name").join(c.files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("k")), key, "left").select(F.lit(side).alias("side"), F.col("name").alias("value"), F.coalesce("k", F.lit(0)).alias("n"))
    return own("folder", "parent_dir").unionByName(own("lang", "lang")).unionByName(of("drive", c.volumes, "volume_id")).unionByName(of("repo", c.repos, "repo_id"))


@query("value_counts_folder", "SELECT parent_dir AS value, count(*) AS n FROM listing l JOIN (SELECT id, parent_dir FROM files) USING (id) WHERE l.source_kind = 'file' GROUP BY 1 ORDER BY n DESC, value LIMIT 40")
def value_counts_folder(c: Corpus):
    rows = c.files.filter("source_kind = 'file'")
    return rows.groupBy(F.col("parent_dir").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(40)


@query("value_counts_who", "SELECT p.name AS value, count(DISTINCT f.file_id) AS n FROM faces f JOIN piles p ON p.id = f.pile WHERE p.name IS NOT NULL GROUP BY 1")
def value_counts_who(c: Corpus):
    named = c.piles.filter("name is not null").select(F.col("id").alias("pile"), F.col("name").alias("value"))
    return c.faces.join(named, "pile").groupBy("value").agg(F.countDistinct("file_id").alias("n"))


@query("value_counts_place", "SELECT place AS value, count(*) AS n FROM listing WHERE place IS NOT NULL GROUP BY 1")
def value_counts_place(c: Corpus):
    return c.listing.filter("place is not null").groupBy(F.col("place").alias("value")).agg(F.count("*").alias("n"))


# ---- tidying


@query("tidy_overview", "SELECT 'kind' AS part, ext AS name, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files WHERE volume_id IS NULL GROUP BY 2 QUALIFY row_number() OVER (ORDER BY sum(size_bytes) DESC, ext) <= 12 UNION ALL SELECT 'here', 'files', count(*), CAST(sum(size_bytes) AS BIGINT) FROM files WHERE volume_id IS NULL UNION ALL SELECT 'here', 'pictures', count(*), CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM files WHERE volume_id IS NULL AND ext = 'jpg' UNION ALL SELECT 'away', 'files', count(*), CAST(sum(size_bytes) AS BIGINT) FROM files WHERE volume_id IS NOT NULL UNION ALL SELECT 'root', r.root, count(*), CAST(sum(size_bytes) AS BIGINT) FROM (VALUES ('/corpus/src1'), ('/corpus/src2')) r(root) JOIN files ON starts_with(path, r.root || '/') WHERE volume_id IS NULL GROUP BY 2")
def tidy_overview(c: Corpus):
    local, bytes_ = c.files.filter("volume_id is null"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    line = lambda df, part, name: df.agg(F.count("*").alias("n"), bytes_).select(F.lit(part).alias("part"), F.lit(name).alias("name"), "n", "bytes")
    kinds = local.groupBy(F.col("ext").alias("name")).agg(F.count("*").alias("n"), bytes_).orderBy(F.desc("bytes"), "name").limit(12).select(F.lit("kind").alias("part"), "name", "n", "bytes")
    out = kinds.unionByName(line(local, "here", "files")).unionByName(line(local.filter("ext = 'jpg'"), "here", "pictures")).unionByName(line(c.files.filter("volume_id is not null"), "away", "files"))
    for root in ("/corpus/src1", "/corpus/src2"):
        out = out.unionByName(line(local.filter(T.under_root(F.col("path"), root)), "root", root))
    return out


SPARE = "SELECT id, content_hash, mtime_ns, CASE id % 4 WHEN 0 THEN '/home/Downloads/' || id || '.pdf' WHEN 1 THEN '/home/a/Copy of ' || id || '.pdf' WHEN 2 THEN '/home/a/' || id || ' (1).pdf' ELSE path END AS path FROM files WHERE content_hash IS NOT NULL"


def _spare(c: Corpus):
    i, s = F.col("id") % 4, F.col("id").cast("string")
    path = F.when(i == 0, F.concat(F.lit("/home/Downloads/"), s, F.lit(".pdf"))).when(i == 1, F.concat(F.lit("/home/a/Copy of "), s, F.lit(".pdf"))).when(i == 2, F.concat(F.lit("/home/a/"), s, F.lit(" (1).pdf"))).otherwise(F.col("path"))
    return c.files.filter("content_hash is not null").select("id", "content_hash", "mtime_ns", path.alias("path"))


for _rule, _order in (("oldest", "mtime_ns, path"), ("newest", "-mtime_ns, path"), ("default", f"contains(lower(path), '/downloads/'), regexp_matches(regexp_replace({BASENAME}, '\\.[^.]*$', ''), '(?i)^copy of |\\([0-9]{{1,3}}\\)$'), mtime_ns, length({BASENAME}), path")):
    query(f"keep_{_rule}", f"SELECT content_hash, id AS keep_id FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY {_order}) AS r FROM ({SPARE})) WHERE r = 1 AND n > 1")(
        lambda c, rule=_rule: tidy.keepers(_spare(c), "content_hash", rule)
    )


@query("removed_and_put_back", "SELECT user_id AS id, max(event_id) AS at FROM (SELECT *, CASE WHEN event_type IN ('error', 'click') THEN 'remove' ELSE 'put back' END AS action FROM events) GROUP BY 1 HAVING arg_max(action, event_id) = 'remove'")
def removed_and_put_back(c: Corpus):
    action = F.when(F.col("event_type").isin("error", "click"), "remove").otherwise("put back")
    return tidy.gone(c.table("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), action.alias("action")))


@query("tidy_bins", "SELECT user_id AS batch, min(event_id) AS first_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def tidy_bins(c: Corpus):
    return c.table("events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("batch")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


# ---- pictures

#: A 64-bit hash of a picture: of its text, with some low bits turned in each fifth.
PHASH = "CAST(('0x' || substr(md5(CAST(id % 40 AS VARCHAR)), 1, 15)) AS BIGINT)"
PHOTOS = f"SELECT id, parent_dir, taken_at_ns, size_bytes, CASE WHEN id % 5 = 0 THEN xor({PHASH}, id % 64) ELSE {PHASH} END AS h FROM files WHERE ext = 'jpg'"


def _photos(c: Corpus):
    h = F.conv(F.substring(F.md5((F.col("id") % 40).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    turned = F.when(F.col("id") % 5 == 0, h.bitwiseXOR(F.col("id") % 64)).otherwise(h)
    return c.files.filter("ext = 'jpg'").select("id", "parent_dir", "taken_at_ns", "size_bytes", turned.alias("h"))


@query("phash_pairs", f"SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS bits FROM ({PHOTOS}) a JOIN ({PHOTOS}) b ON a.parent_dir = b.parent_dir AND a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 16")
def phash_pairs(c: Corpus):
    return tidy.near_hashes(_photos(c).select(F.col("parent_dir").alias("grp"), "id", "h"))


@query("phash_clusters", None)
def phash_clusters(c: Corpus):
    photos = _photos(c)
    # Equal hashes are one picture; the distinct ones are compared.
    firsts = photos.groupBy("h").agg(F.min("id").alias("id"))
    pairs = tidy.near_hashes(firsts.select(F.lit(0).alias("grp"), "id", "h"))
    found = tidy.greedy_clusters(firsts, pairs)
    return photos.select("id", "h").join(firsts.join(found, "id").select("h", "cluster"), "h").select("id", "cluster")


@query("similar_sets", None)
def similar_sets(c: Corpus):
    sizes = phash_clusters(c).join(_photos(c).select("id", "size_bytes"), "id")
    return sizes.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest")).filter("n > 1")


@query("hash_distance", f"SELECT id, CASE WHEN id % 9 = 0 THEN 999 ELSE CAST(bit_count(xor(h, 255)) AS INT) END AS bits FROM ({PHOTOS})")
def hash_distance(c: Corpus):
    # A hash that isn't one is far from all.
    h = F.when(F.col("id") % 9 != 0, F.col("h"))
    return _photos(c).select("id", F.coalesce(V.hamming(h, F.lit(255).cast("long")), F.lit(999)).alias("bits"))


@query("photo_reuse", f"SELECT id, other, bits FROM (SELECT a.id, b.id AS other, CAST(bit_count(xor(a.h, b.h)) AS INT) AS bits, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.h, b.h)), abs(a.taken_at_ns - b.taken_at_ns), b.id) AS r FROM ({PHOTOS}) a JOIN ({PHOTOS}) b ON a.parent_dir = b.parent_dir AND a.id <> b.id AND abs(a.taken_at_ns - b.taken_at_ns) <= {200 * DAY_NS} AND bit_count(xor(a.h, b.h)) < 8) WHERE r = 1")
def photo_reuse(c: Corpus):
    return tidy.reused(_photos(c).select(F.col("parent_dir").alias("grp"), "id", "h", F.col("taken_at_ns").alias("at")), 7, 200 * DAY_NS)


@query("reverse_image", f"SELECT id, CASE WHEN bit_count(xor(h, q)) <= 16 THEN 'exact' ELSE 'similar' END AS label FROM ({PHOTOS}), (SELECT h AS q FROM ({PHOTOS}) ORDER BY id LIMIT 1)")
def reverse_image(c: Corpus):
    p = _photos(c)
    asked = p.orderBy("id").limit(1).select(F.col("h").alias("q"))
    return p.join(F.broadcast(asked)).select("id", F.when(V.hamming(F.col("h"), F.col("q")) <= 16, "exact").otherwise("similar").alias("label"))


@query("photo_library", "SELECT f.id, f.path, t.tags, w.people, coalesce(n.faces, 0) AS faces FROM files f LEFT JOIN (SELECT file_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM file_tags GROUP BY 1) t ON f.id = t.file_id LEFT JOIN (SELECT file_id, string_agg(DISTINCT p.name, ',' ORDER BY p.name) AS people FROM faces JOIN piles p ON p.id = pile WHERE p.name IS NOT NULL GROUP BY 1) w ON f.id = w.file_id LEFT JOIN (SELECT file_id, count(*) AS faces FROM faces GROUP BY 1) n ON f.id = n.file_id WHERE f.ext = 'jpg'")
def photo_library(c: Corpus):
    listed = lambda column: F.array_join(F.sort_array(F.collect_set(column)), ",")
    tags = c.file_tags.groupBy(F.col("file_id").alias("id")).agg(listed("tag").alias("tags"))
    named = c.piles.filter("name is not null").select(F.col("id").alias("pile"), "name")
    people = c.faces.join(named, "pile").groupBy(F.col("file_id").alias("id")).agg(listed("name").alias("people"))
    count = c.faces.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    out = c.files.filter("ext = 'jpg'").select("id", "path").join(tags, "id", "left").join(people, "id", "left").join(count, "id", "left")
    return out.select("id", "path", "tags", "people", F.coalesce("n", F.lit(0)).alias("faces"))


@query("suggestion_counts", "SELECT pile, count(*) AS n, array_to_string(list(face ORDER BY face)[1:3], ',') AS sample FROM faces WHERE pile IS NOT NULL GROUP BY 1")
def suggestion_counts(c: Corpus):
    # The three least faces are kept by rank; no list of all of them is made.
    own = F.row_number().over(Window.partitionBy("pile").orderBy("face"))
    ranked = c.faces.filter("pile is not null").withColumn("r", own)
    few = ranked.filter("r <= 3").groupBy("pile").agg(F.array_join(F.transform(F.sort_array(F.collect_list("face")), lambda x: x.cast("string")), ",").alias("sample"))
    return ranked.groupBy("pile").agg(F.count("*").alias("n")).join(few, "pile")


@query("combine_piles", "SELECT coalesce(CASE WHEN pile = 4 THEN 1 ELSE pile END, -1) AS pile, count(*) AS n FROM faces GROUP BY 1")
def combine_piles(c: Corpus):
    moved = F.when(F.col("pile") == 4, 1).otherwise(F.col("pile"))
    return c.faces.groupBy(F.coalesce(moved, F.lit(-1)).alias("pile")).agg(F.count("*").alias("n"))


@query("face_quality", "SELECT vec_id FROM embeddings WHERE round(50 * abs(CAST(embedding[1] AS DOUBLE)), 6) >= 5.0 AND vec_id % 7 <= 3")
def face_quality(c: Corpus):
    detail, blocks = F.round(50 * F.abs(F.get("embedding", F.lit(0)).cast("double")), 6), F.col("vec_id") % 7
    return c.table("embeddings").filter((detail >= 5.0) & (blocks <= 3)).select("vec_id")


# ---- changes


@query("requeue_backoff", "SELECT event_id, attempt, t + [20, 30, 60, 120, 300, 600][least(attempt, 6)] AS next_at FROM (SELECT event_id, epoch(ts) AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt FROM events WHERE event_type = 'error')")
def requeue_backoff(c: Corpus):
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tries = c.table("events").filter("event_type = 'error'").withColumn("attempt", attempt)
    delay = F.element_at(F.lit([20, 30, 60, 120, 300, 600]), F.least(F.col("attempt"), F.lit(6)))
    return tries.select("event_id", "attempt", (F.col("ts").cast("timestamp").cast("double") + delay).alias("next_at"))


@query("batch_apply", "SELECT user_id AS path, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'delete' ELSE 'upsert' END AS action, count(*) AS n FROM events GROUP BY 1")
def batch_apply(c: Corpus):
    last = F.max_by("event_type", "event_id")
    return c.table("events").groupBy(F.col("user_id").alias("path")).agg(F.when(last == "error", "delete").otherwise("upsert").alias("action"), F.count("*").alias("n"))


@query("twin_vectors", "SELECT a.id, min(b.id) AS twin FROM (SELECT id, text FROM chunks WHERE file_id % 3 <> 0) a JOIN (SELECT id, text FROM chunks WHERE file_id % 3 = 0) b ON a.text = b.text GROUP BY 1")
def twin_vectors(c: Corpus):
    # One passage a text first: a text that many files share is joined once.
    h = F.sha2(F.col("text").cast("binary"), 256).alias("h")
    done = c.chunks.filter("file_id % 3 = 0").groupBy(h).agg(F.min("id").alias("twin"))
    return c.chunks.filter("file_id % 3 != 0").select("id", h).join(done, "h").select("id", "twin")


@query("retry_plan", "SELECT ext, count(*) AS n, CAST(60 * (1 + count(*) % 3) * 2 AS BIGINT) AS limit_s FROM files WHERE skip_code = 'TIMEOUT' GROUP BY 1")
def retry_plan(c: Corpus):
    rows = c.files.filter("skip_code = 'TIMEOUT'").groupBy("ext").agg(F.count("*").alias("n"))
    return rows.select("ext", "n", (60 * (1 + F.col("n") % 3) * 2).cast("long").alias("limit_s"))
