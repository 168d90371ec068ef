"""Filters, browsing, counts, value menus, timeline and space reports over files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import filters, reports
from brindle.plans import questions
from brindle.plans.grammar import parse
from brindle.queries.registry import query
from brindle.sources.corpus import BASE_NS, DAY_NS, Corpus

TODAY = dt.date(2024, 1, 1)
EFFECTIVE = "coalesce(taken_at_ns, mtime_ns)"
MAIL = "source_kind IN ('eml', 'msg', 'pst', 'mbox')"
BASENAME = "regexp_extract(path, '[^/]*$')"


def listed(text: str):
    return lambda c: filters.apply(c.files, parse(text, TODAY), c).select("id", "path")


def _filter(name: str, text: str, where: str) -> None:
    query(name, f"SELECT id, path FROM files WHERE {where}")(listed(text))


_filter("filter_type_in", "type:pdf,docx", "ext IN ('pdf', 'docx')")
_filter("filter_type_group", "type:text", "ext IN ('txt', 'md')")
_filter("filter_type_glob", "type:*x", "ext LIKE '%x'")
_filter("filter_not_type", "-type:pdf", "ext <> 'pdf'")
_filter("filter_path_contains", "path:SRC1 path:/en", "lower(path) LIKE '%src1%' AND lower(path) LIKE '%/en%'")
_filter("filter_name_glob", "name:doc_1*.txt", rf"regexp_matches({BASENAME}, '^doc_1.*\.txt$')")
_filter("filter_not_name", "-name:_2", rf"NOT {BASENAME} LIKE '%\_2%' ESCAPE '\'")
_filter("filter_size", "size:>2kb size:<=8kb", "size_bytes > 2048 AND size_bytes <= 8192")
_filter("filter_after", "after:2023-06", f"{EFFECTIVE} >= 1685577600000000000")
_filter("filter_date_range", "date:2022", f"{EFFECTIVE} BETWEEN 1640995200000000000 AND 1672531199999999000")
_filter("filter_relative_date", "after:90d", f"{EFFECTIVE} >= {BASE_NS - 90 * DAY_NS}")
_filter("filter_status_words", "status:timedout,done", "status IN ('SKIPPED', 'INDEXED')")
_filter("filter_between", "between:2021-03 and 2022", f"{EFFECTIVE} BETWEEN 1614556800000000000 AND 1672531199999999000")
_filter("filter_dates_reversed", "after:2023 before:2021", f"{EFFECTIVE} BETWEEN 1609459200000000000 AND 1704067199999999000")
_filter("filter_star_extension", "*.pdf -*.txt", "ext = 'pdf' AND ext <> 'txt'")
_filter("filter_open_span", "date:..2021-06", f"{EFFECTIVE} <= 1625097599999999000")
_filter("filter_status", "status:failed status:pending", "status IN ('FAILED', 'PENDING')")
_filter("filter_scope_mail", "scope:mail", MAIL)
_filter("filter_scope_documents", "scope:documents", f"NOT {MAIL}")
_filter("filter_scope_code", "scope:code", "repo_id IS NOT NULL")
_filter("semi_repo", "repo:repo_3", "repo_id IN (SELECT id FROM repos WHERE name LIKE '%repo_3%')")
_filter("anti_null_safe_repo", "-repo:repo_3", "repo_id IS NULL OR repo_id NOT IN (SELECT id FROM repos WHERE name LIKE '%repo_3%')")
_filter("semi_volume", "on:office", "volume_id IN (SELECT id FROM volumes WHERE lower(name) LIKE '%office%')")
_filter("semi_tag", "shows:quality", "id IN (SELECT file_id FROM file_tags WHERE tag = 'quality')")
_filter("anti_tag", "-shows:quality", "id NOT IN (SELECT file_id FROM file_tags WHERE tag = 'quality')")
_filter("filter_switches", "/type pdf /in src1 size:>1kb", "ext = 'pdf' AND lower(path) LIKE '%src1%' AND size_bytes > 1024")
del _filter


def _listing(name: str, text: str, where: str) -> None:
    """A filter over the list of files, messages and attachments."""
    query(name, f"SELECT id, path FROM listing f WHERE {where}")(lambda c: filters.apply(c.listing, parse(text, TODAY), c).select("id", "path"))


MAIL_IN = "id IN (SELECT mail_id FROM messages WHERE %s)"
_listing("filter_from", "from:ASSIST", MAIL_IN % "lower(sender) LIKE '%assist%'")
_listing("filter_not_from", "-from:assist scope:mail", f"{MAIL} AND NOT " + MAIL_IN % "lower(sender) LIKE '%assist%'")
_listing("filter_to", "to:user@example.com", MAIL_IN % "len(list_filter(recipients, lambda r: contains(lower(r), 'user@example.com'))) > 0")
_listing("filter_not_to", "-to:user scope:mail", f"{MAIL} AND NOT " + MAIL_IN % "len(list_filter(recipients, lambda r: contains(lower(r), 'user'))) > 0")
_listing("filter_subject", 'subject:"conversation 1"', MAIL_IN % "lower(subject) LIKE '%conversation 1%'")
_listing("filter_not_subject", "-subject:1 scope:mail", f"{MAIL} AND NOT " + MAIL_IN % "lower(subject) LIKE '%1%'")
_listing("filter_from_nobody", "from:nobody", "false")
_listing("filter_has_attachment", "has:attachment", MAIL_IN % "has_attach")
_listing("filter_no_attachment", "-has:attachment", MAIL_IN % "NOT has_attach")
ATTACHED = "path IN (SELECT split_part(path, '/attachments/', 1) FROM listing WHERE contains(path, '/attachments/') AND regexp_extract(path, '[^/]*$') LIKE '%s')"
_listing("filter_attachment", "attachment:report_3*.pdf", ATTACHED % "report\\_3%.pdf' ESCAPE '\\")
_listing("filter_not_attachment", "-attachment:report_3 from:user", "NOT " + ATTACHED % "%report\\_3%' ESCAPE '\\" + " AND " + MAIL_IN % "lower(sender) LIKE '%user%'")
_listing("filter_mailbox", "mailbox:archive_3", MAIL_IN % "archive LIKE '%archive\\_3%' ESCAPE '\\'")
_listing("filter_mailfolder", "mailfolder:inbox*", MAIL_IN % "lower(folder) LIKE 'inbox%'")
_listing("filter_place", "place:Porto,place place:leeds", "lower(place) IN ('porto,place', 'leeds')")
_listing("filter_not_place", "-place:l*", "place IS NULL OR NOT lower(place) LIKE 'l%'")
_listing("filter_who", 'who:"person 1"', "id IN (SELECT file_id FROM faces JOIN piles p ON p.id = pile WHERE lower(p.name) = 'person 1')")
_listing("filter_not_who", "-who:person* type:jpg", "ext = 'jpg' AND id NOT IN (SELECT file_id FROM faces JOIN piles p ON p.id = pile WHERE lower(p.name) LIKE 'person%')")
_listing("only_named", "only:named", "EXISTS (SELECT 1 FROM faces JOIN piles p ON p.id = pile WHERE file_id = f.id AND p.name IS NOT NULL)")
_listing("only_unnamed", "only:unnamed", "EXISTS (SELECT 1 FROM faces LEFT JOIN piles p ON p.id = pile WHERE file_id = f.id AND p.name IS NULL)")
_listing("not_only_named", "-only:named type:jpg", "ext = 'jpg' AND NOT EXISTS (SELECT 1 FROM faces JOIN piles p ON p.id = pile WHERE file_id = f.id AND p.name IS NOT NULL)")
_listing("only_no_faces", "only:no-faces", "ext = 'jpg' AND NOT EXISTS (SELECT 1 FROM faces WHERE file_id = f.id)")
_listing("only_mail_pictures", "only:mail", "contains(path, '/attachments/')")
_listing("filter_negated_path_and_name", "-path:src1 -name:*7.pdf", "NOT lower(path) LIKE '%src1%' AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '7\\.pdf$')")
del _listing


@query("files_newest", f"SELECT id, path, {EFFECTIVE} AS when_ns FROM files ORDER BY when_ns DESC, id LIMIT 50")
def files_newest(c: Corpus):
    return reports.newest(c.files, 50)


@query("files_by_name", f"SELECT id, path FROM files ORDER BY lower({BASENAME}), path LIMIT 50")
def files_by_name(c: Corpus):
    return c.files.select("id", "path").orderBy(F.lower(T.basename(F.col("path"))), "path").limit(50)


@query("offset_page", "SELECT id, path, size_bytes FROM files ORDER BY size_bytes DESC, id LIMIT 20 OFFSET 40")
def offset_page(c: Corpus):
    return c.files.select("id", "path", "size_bytes").orderBy(F.desc("size_bytes"), "id").offset(40).limit(20)


@query("capped_count", "SELECT count(*) AS n FROM (SELECT DISTINCT id FROM files WHERE ext = 'pdf' LIMIT 101)")
def capped_count(c: Corpus):
    return c.files.filter("ext = 'pdf'").select("id").distinct().limit(101).agg(F.count("*").alias("n"))


@query("large_files", "SELECT id, path, size_bytes FROM files WHERE size_bytes >= 20000 ORDER BY size_bytes DESC, id LIMIT 200")
def large_files(c: Corpus):
    return c.files.filter("size_bytes >= 20000").select("id", "path", "size_bytes").orderBy(F.desc("size_bytes"), "id").limit(200)


@query("union_name_content", "SELECT id, min(score) AS score FROM (SELECT id, 0 AS score FROM files WHERE path LIKE '%doc_1%' UNION ALL SELECT doc_id AS id, 1 AS score FROM documents WHERE lower(text) LIKE '%license%') GROUP BY id")
def union_name_content(c: Corpus):
    names = c.files.filter(F.col("path").contains("doc_1")).select("id", F.lit(0).alias("score"))
    bodies = c.table("documents").filter(F.lower("text").contains("license")).select(F.col("doc_id").alias("id"), F.lit(1).alias("score"))
    return names.unionByName(bodies).groupBy("id").agg(F.min("score").alias("score"))


@query("repos_with_matches", "SELECT DISTINCT repo_id FROM (SELECT repo_id FROM files WHERE path LIKE '%/en/%' UNION SELECT repo_id FROM files WHERE lower(text) LIKE '%license%') WHERE repo_id IS NOT NULL")
def repos_with_matches(c: Corpus):
    by_name = c.files.filter(F.col("path").contains("/en/")).select("repo_id")
    by_text = c.texts.filter(F.lower("text").contains("license")).select("repo_id")
    return by_name.union(by_text).filter("repo_id is not null").distinct()


for _kind in ("ext", "parent_dir", "status", "source"):
    query(f"value_counts_{_kind}", f"SELECT {_kind} AS value, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, value LIMIT 40")(
        lambda c, k=_kind: reports.value_counts(c.files, k, 40)
    )


@query("value_counts_repo", "SELECT r.name AS value, count(f.id) AS n FROM repos r LEFT JOIN files f ON f.repo_id = r.id GROUP BY 1")
def value_counts_repo(c: Corpus):
    return c.repos.join(c.files.select("id", F.col("repo_id")).withColumnRenamed("id", "file"), F.col("repo_id") == F.col("id"), "left").groupBy(F.col("name").alias("value")).agg(F.count("file").alias("n"))


@query("value_counts_shows", "SELECT tag AS value, count(DISTINCT file_id) AS n FROM file_tags GROUP BY 1")
def value_counts_shows(c: Corpus):
    return c.file_tags.groupBy(F.col("tag").alias("value")).agg(F.countDistinct("file_id").alias("n"))


@query("value_counts_prefix", "SELECT source AS value, count(*) AS n FROM files WHERE source LIKE 'src1%' GROUP BY 1 ORDER BY n DESC, value LIMIT 40")
def value_counts_prefix(c: Corpus):
    return reports.value_counts(c.files.filter(F.col("source").startswith("src1")), "source", 40)


STATE = "CASE WHEN v.state IN ('OFFLINE', 'ARCHIVED') THEN 'Offline' WHEN status = 'INDEXED' THEN 'Indexed' WHEN status = 'PENDING' THEN 'Queued' WHEN status = 'NAME_ONLY' THEN 'Name only' WHEN skip_code = 'TIMEOUT' THEN 'Timed out' WHEN status = 'SKIPPED' THEN 'Skipped' ELSE 'Failed' END"


@query("status_funnel", f"SELECT {STATE} AS state, count(*) AS n FROM files f LEFT JOIN volumes v ON f.volume_id = v.id GROUP BY 1")
def status_funnel(c: Corpus):
    return reports.status_funnel(c.files, c.volumes)


@query("skip_summary", "SELECT skip_code, count(*) AS n FROM files WHERE skip_code IS NOT NULL GROUP BY 1")
def skip_summary(c: Corpus):
    return c.files.filter("skip_code is not null").groupBy("skip_code").agg(F.count("*").alias("n"))


@query("timed_out_groups", "SELECT ext, count(*) AS n FROM files WHERE skip_code = 'TIMEOUT' GROUP BY 1")
def timed_out_groups(c: Corpus):
    return c.files.filter("skip_code = 'TIMEOUT'").groupBy("ext").agg(F.count("*").alias("n"))


@query("totals", "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(content_hash) AS hashed, count(DISTINCT content_hash) AS contents, min(mtime_ns) AS oldest, max(mtime_ns) AS newest FROM files")
def totals(c: Corpus):
    return c.files.agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count("content_hash").alias("hashed"), F.countDistinct("content_hash").alias("contents"),
        F.min("mtime_ns").alias("oldest"), F.max("mtime_ns").alias("newest"),
    )


@query("side_counts", "SELECT t.ext, count(f.id) AS n FROM (SELECT unnest(['pdf','docx','txt','md','eml','jpg','py','xlsx','csv','mp4']) AS ext) t LEFT JOIN files f ON f.ext = t.ext GROUP BY 1")
def side_counts(c: Corpus):
    always = c.spark.createDataFrame([(e,) for e in ("pdf", "docx", "txt", "md", "eml", "jpg", "py", "xlsx", "csv", "mp4")], "ext string")
    return always.join(c.files.groupBy("ext").agg(F.count("*").alias("k")), "ext", "left").select("ext", F.coalesce("k", F.lit(0)).alias("n"))


@query("folder_counts", "SELECT split_part(path, '/', 3) AS folder, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(mtime_ns) AS oldest, max(mtime_ns) AS newest FROM files GROUP BY 1")
def folder_counts(c: Corpus):
    return c.files.groupBy(F.split_part("path", F.lit("/"), F.lit(3)).alias("folder")).agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.min("mtime_ns").alias("oldest"), F.max("mtime_ns").alias("newest")
    )


@query("volume_folder_counts", "SELECT v.name, split_part(f.path, '/', 3) AS folder, count(*) AS n FROM files f JOIN volumes v ON f.volume_id = v.id GROUP BY 1, 2")
def volume_folder_counts(c: Corpus):
    named = c.volumes.select(F.col("id").alias("volume_id"), "name")
    return c.files.join(named, "volume_id").groupBy("name", F.split_part("path", F.lit("/"), F.lit(3)).alias("folder")).agg(F.count("*").alias("n"))


@query("picture_counts", "SELECT count_if(ext = 'jpg') AS pictures, count_if(ext = 'jpg' AND taken_at_ns IS NOT NULL) AS dated, count_if(ext = 'jpg' AND status = 'INDEXED') AS described, count_if(ext = 'jpg' AND volume_id IS NOT NULL) AS offline FROM files")
def picture_counts(c: Corpus):
    jpg = F.col("ext") == "jpg"
    return c.files.agg(
        F.count_if(jpg).alias("pictures"), F.count_if(jpg & F.col("taken_at_ns").isNotNull()).alias("dated"),
        F.count_if(jpg & (F.col("status") == "INDEXED")).alias("described"), F.count_if(jpg & F.col("volume_id").isNotNull()).alias("offline"),
    )


GROUPS = "SELECT content_hash, count(*) AS copies, max(size_bytes) AS size_bytes, min(id) AS first_id FROM files WHERE content_hash IS NOT NULL AND content_hash <> '' GROUP BY content_hash HAVING count(*) > 1"


@query("dup_groups", f"SELECT content_hash, copies, size_bytes, first_id, (copies - 1) * size_bytes AS reclaimable FROM ({GROUPS}) ORDER BY reclaimable DESC, content_hash LIMIT 25")
def dup_groups(c: Corpus):
    return reports.duplicate_groups(c.files).orderBy(F.desc("reclaimable"), "content_hash").limit(25)


@query("dup_members", f"WITH g AS ({GROUPS}) SELECT f.content_hash, f.id, f.path FROM files f JOIN g ON f.content_hash = g.content_hash")
def dup_members(c: Corpus):
    return c.files.join(reports.duplicate_groups(c.files).select("content_hash"), "content_hash", "left_semi").select("content_hash", "id", "path")


@query("reclaimable", f"SELECT CAST(coalesce(sum((copies - 1) * size_bytes), 0) AS BIGINT) AS bytes FROM ({GROUPS})")
def reclaimable(c: Corpus):
    return reports.duplicate_groups(c.files).agg(F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("bytes"))


@query("dup_share", f"WITH g AS ({GROUPS}) SELECT coalesce(v.name, 'this machine') AS source, count(*) AS files, count_if(g.content_hash IS NOT NULL) AS duplicated FROM files f LEFT JOIN g ON f.content_hash = g.content_hash LEFT JOIN volumes v ON f.volume_id = v.id WHERE f.content_hash IS NOT NULL GROUP BY 1")
def dup_share(c: Corpus):
    return reports.duplicate_share(c.files, c.volumes)


@query("uniqueness", "SELECT coalesce(v.name, 'this machine') AS source, count(*) AS only_copies FROM files f JOIN (SELECT content_hash FROM files WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) = 1) u ON f.content_hash = u.content_hash LEFT JOIN volumes v ON f.volume_id = v.id GROUP BY 1")
def uniqueness(c: Corpus):
    return reports.only_copies(c.files, c.volumes)


@query("hash_coverage", "SELECT count(*) AS files, count(content_hash) AS hashed FROM files")
def hash_coverage(c: Corpus):
    return c.files.agg(F.count("*").alias("files"), F.count("content_hash").alias("hashed"))


@query("copy_sets", "SELECT content_hash, count(*) AS copies, min(id) AS first_id FROM files WHERE volume_id IS NULL AND size_bytes > 0 AND content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def copy_sets(c: Corpus):
    local = c.files.filter("volume_id is null and size_bytes > 0 and content_hash is not null")
    return local.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


@query("copies_elsewhere", "SELECT DISTINCT f.id, v.name FROM files f JOIN files o ON f.content_hash = o.content_hash AND f.id <> o.id JOIN volumes v ON o.volume_id = v.id WHERE f.volume_id IS NULL")
def copies_elsewhere(c: Corpus):
    # Distinct volumes a hash first: a hash with many copies must not meet itself row by row.
    held = c.files.filter("volume_id is not null and content_hash is not null").select("content_hash", "volume_id").distinct()
    named = held.join(c.volumes.select(F.col("id").alias("volume_id"), "name"), "volume_id").select("content_hash", "name")
    return c.files.filter("volume_id is null").select("id", "content_hash").join(named, "content_hash").select("id", "name")


LEFT = "SELECT id, size_bytes, CASE id % 11 WHEN 0 THEN path || '.part' WHEN 1 THEN regexp_replace(path, '([^/]*)$', '~$\\1') WHEN 2 THEN '/home/Downloads/setup_' || id || '.msi' WHEN 3 THEN '/home/apps/setup_' || id || '.msi' ELSE path END AS path FROM files WHERE volume_id IS NULL"


@query("leftovers", f"SELECT id, path FROM ({LEFT}) WHERE regexp_matches(lower(path), '\\.(tmp|temp|part|partial|crdownload|download)$') OR starts_with({BASENAME}, '~$') OR (regexp_matches(lower(path), '\\.(msi|exe|dmg|pkg|iso)$') AND contains(lower(path), '/downloads/'))")
def leftovers(c: Corpus):
    i = F.col("id") % 11
    name = lambda where: F.concat(F.lit(f"/home/{where}/setup_"), F.col("id").cast("string"), F.lit(".msi"))
    path = F.when(i == 0, F.concat("path", F.lit(".part"))).when(i == 1, F.regexp_replace("path", "([^/]+)$", "~\\$$1")).when(i == 2, name("Downloads")).when(i == 3, name("apps")).otherwise(F.col("path"))
    return c.files.filter("volume_id is null").select("id", path.alias("path")).filter(reports.is_leftover(F.col("path")))


@query("keeper_rule", f"WITH g AS ({GROUPS}) SELECT content_hash, id AS keep_id FROM (SELECT f.content_hash, f.id, row_number() OVER (PARTITION BY f.content_hash ORDER BY f.volume_id IS NOT NULL, f.mtime_ns, length(f.path), f.path) AS r FROM files f JOIN g ON f.content_hash = g.content_hash) WHERE r = 1")
def keeper_rule(c: Corpus):
    return reports.keepers(c.files)


TWINS = "SELECT id, path FROM files UNION ALL SELECT id + 1000000, upper(path) FROM files WHERE id % 9 = 0"


@query("case_twins", f"WITH t AS ({TWINS}), g AS (SELECT lower(path) AS p FROM t GROUP BY 1 HAVING count(DISTINCT path) > 1) SELECT t.id, t.path FROM t JOIN g ON lower(t.path) = g.p")
def case_twins(c: Corpus):
    again = c.files.filter("id % 9 = 0").select((F.col("id") + 1000000).alias("id"), F.upper("path").alias("path"))
    return reports.case_twins(c.files.select("id", "path").unionByName(again))


BRANCHES = f"SELECT {EFFECTIVE} AS when_ns, CASE WHEN taken_at_ns IS NOT NULL THEN 0 ELSE 1 END AS branch, id FROM files UNION ALL SELECT sent_at * 1000000000, 2, file_id FROM messages WHERE sent_at IS NOT NULL"
START, STOP = BASE_NS - 400 * DAY_NS, BASE_NS + DAY_NS


@query("timeline_page", f"SELECT when_ns, branch, id FROM ({BRANCHES}) WHERE when_ns >= {START} AND when_ns < {STOP} ORDER BY when_ns, branch, id LIMIT 51")
def timeline_page(c: Corpus):
    return reports.timeline_page(reports.timeline(c.files, c.messages), START, STOP, None, 50)


@query("keyset_page", f"SELECT when_ns, branch, id FROM ({BRANCHES}) WHERE when_ns >= {START} AND when_ns < {STOP} AND (when_ns, branch, id) > ({BASE_NS - 200 * DAY_NS}, 1, 300) ORDER BY when_ns, branch, id LIMIT 51")
def keyset_page(c: Corpus):
    return reports.timeline_page(reports.timeline(c.files, c.messages), START, STOP, (BASE_NS - 200 * DAY_NS, 1, 300), 50)


@query("timeline_overview", f"SELECT strftime(make_timestamp(when_ns // 1000), '%Y%m') AS month, branch, count(*) AS n FROM ({BRANCHES}) GROUP BY 1, 2")
def timeline_overview(c: Corpus):
    return reports.timeline(c.files, c.messages).groupBy(reports.month_of("when_ns").alias("month"), "branch").agg(F.count("*").alias("n"))


@query("timeline_running", f"SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS running FROM (SELECT strftime(make_timestamp(when_ns // 1000), '%Y%m') AS month, count(*) AS n FROM ({BRANCHES}) GROUP BY 1)")
def timeline_running(c: Corpus):
    months = reports.timeline(c.files, c.messages).groupBy(reports.month_of("when_ns").alias("month")).agg(F.count("*").alias("n"))
    # One row a month: the window over all of them stays small at any size.
    return months.withColumn("running", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


@query("share_of_total", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM files GROUP BY 1")
def share_of_total(c: Corpus):
    counts = c.files.groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


for _op, _spark, _sql in (
    ("count", lambda f: f.agg(F.count("*").alias("n")), "count(*) AS n"),
    ("size", lambda f: f.agg(F.sum("size_bytes").alias("bytes")), "CAST(sum(size_bytes) AS BIGINT) AS bytes"),
    ("newest", lambda f: f.agg(F.max_by("id", F.struct(filters.effective_ns(), -F.col("id"))).alias("id")), "max_by(id, (coalesce(taken_at_ns, mtime_ns), -id)) AS id"),
    ("oldest", lambda f: f.agg(F.min_by("id", F.struct(filters.effective_ns(), F.col("id"))).alias("id")), "min_by(id, (coalesce(taken_at_ns, mtime_ns), id)) AS id"),
):
    query(f"topic_aggregate_{_op}", f"SELECT {_sql} FROM files WHERE status IN ('INDEXED', 'PARTIAL', 'NAME_ONLY') AND ext = 'pdf' AND (lower(path) LIKE '%license%' OR lower(text) LIKE '%license%')")(
        lambda c, f=_spark: f(reports.about(c.files.filter("ext = 'pdf'"), ["license"], c.bodies))
    )


@query("corpus_scan", "SELECT ext, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CASE WHEN ext IN ('pdf', 'docx', 'xlsx', 'eml') THEN 'extractor' WHEN ext IN ('txt', 'md', 'py') THEN 'text' WHEN ext = 'jpg' THEN 'ocr' ELSE 'none' END AS tier FROM files GROUP BY 1")
def corpus_scan(c: Corpus):
    return reports.scan(c.files)


@query("read_order", f"SELECT id, row_number() OVER (ORDER BY status <> 'PENDING', -(mtime_ns // {30 * DAY_NS}), size_bytes, id) AS seq FROM files WHERE ext = 'pdf' ORDER BY seq LIMIT 100")
def read_order(c: Corpus):
    keys = [F.col("status") != "PENDING", -F.floor(F.col("mtime_ns") / (30 * DAY_NS)), F.col("size_bytes"), F.col("id")]
    first = c.files.filter("ext = 'pdf'").select("id", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k")).orderBy("k").limit(100)
    return first.select("id", F.row_number().over(Window.orderBy("k")).alias("seq"))


@query("size_words", "SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f', size_bytes / 1024.0) || ' KB' ELSE printf('%.1f', size_bytes / 1048576.0) || ' MB' END AS words FROM files")
def size_words(c: Corpus):
    return c.files.select("id", T.size_words(F.col("size_bytes")).alias("words"))


@query("question_count", f"SELECT count(*) AS n FROM files WHERE ext = 'pdf' AND status IN ('INDEXED', 'PARTIAL', 'NAME_ONLY') AND {EFFECTIVE} BETWEEN 1640995200000000000 AND 1672531199999999000")
def question_count(c: Corpus):
    return questions.answer(c.files, questions.parse_aggregate("How many PDFs in 2022?"), c)


@query("question_people", f"SELECT count(*) AS n FROM listing WHERE ext IN ('eml', 'msg', 'pst', 'mbox') AND {MAIL_IN % "lower(sender) LIKE '%assistant%'"} AND {EFFECTIVE} BETWEEN 1704067200000000000 AND 1735689599999999000")
def question_people(c: Corpus):
    return questions.answer(c.listing, questions.parse_aggregate("How many emails from Assistant in 2024?"), c)


@query("question_people_unknown", "SELECT 0 AS n")
def question_people_unknown(c: Corpus):
    return questions.answer(c.listing, questions.parse_aggregate("How many PDFs from Zebediah?"), c)


@query("question_size", "SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM files WHERE ext IN ('jpg', 'jpeg', 'png', 'gif', 'tiff', 'heic') AND status IN ('INDEXED', 'PARTIAL', 'NAME_ONLY')")
def question_size(c: Corpus):
    return questions.answer(c.files, questions.Aggregate("size", questions.NOUNS["photos"]), c)
