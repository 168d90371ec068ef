"""Mail and contacts: browsing, copies, folders, activity, duplicates, merging and cleaning up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import contacts, mail
from brindle.queries.registry import query
from brindle.sources.corpus import ATTACHMENT_ID, SQL_VIEWS, Corpus

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

#: Messages with copies of some of them, as an archive that was read twice has.
COPIES = "SELECT file_id, archive, path, attachment, sender, subject, sent_at, has_attach, text FROM messages UNION ALL SELECT file_id + 500000, archive, path || '.copy', attachment, sender, subject, sent_at, has_attach, text FROM messages WHERE file_id % 9 = 0"
SQL_VIEWS["copies"] = COPIES
#: Contacts with numbers, some shared, and a favourite mark.
SQL_VIEWS["cards"] = "SELECT *, CASE id % 7 WHEN 0 THEN '+44 7700 900' || (100 + id % 40) WHEN 1 THEN '020 7946 0' || (100 + id % 30) END AS phone, id % 7 = 0 AS mobile, id % 11 = 0 AS favourite FROM contacts"


def _copies(c: Corpus):
    m = c.messages.select("file_id", "archive", "path", "attachment", "sender", "subject", "sent_at", "has_attach", "text")
    again = m.filter("file_id % 9 = 0").withColumns({"file_id": F.col("file_id") + 500000, "path": F.concat("path", F.lit(".copy"))})
    return m.unionByName(again)


def _cards(c: Corpus):
    i = F.col("id")
    phone = F.when(i % 7 == 0, F.concat(F.lit("+44 7700 900"), (100 + i % 40).cast("string"))).when(i % 7 == 1, F.concat(F.lit("020 7946 0"), (100 + i % 30).cast("string")))
    return c.contacts.select("*", phone.alias("phone"), (i % 7 == 0).alias("mobile"), (i % 11 == 0).alias("favourite"))


# ---- mail


@query("mail_browse_words", f"SELECT file_id, subject, sent_at FROM messages WHERE lower(sender) LIKE '%user%' AND len(list_filter(recipients, lambda r: contains(r, 'assistant'))) > 0 AND lower(subject) LIKE '%conversation%' AND sent_at >= 1704067200 AND sent_at < 1704267200 AND list_contains({WORDS}, 'de') ORDER BY sent_at DESC, file_id LIMIT 50")
def mail_browse_words(c: Corpus):
    found = mail.browse(c.messages, sender="USER", recipient="assistant", subject="conversation", after=1704067200, before=1704267200, words=["de"])
    return found.select("file_id", "subject", "sent_at").limit(50)


@query("mail_browse_oldest", "SELECT file_id, sent_at FROM messages WHERE has_attach ORDER BY sent_at NULLS LAST, file_id LIMIT 50")
def mail_browse_oldest(c: Corpus):
    return mail.browse(c.messages, has_attachment=True, newest=False).select("file_id", "sent_at").limit(50)


@query("mail_count_capped", f"SELECT count(*) AS n FROM (SELECT 1 FROM messages WHERE list_contains({WORDS}, 'the') LIMIT 101)")
def mail_count_capped(c: Corpus):
    return c.messages.filter(mail.all_words(F.col("text"), ["the"])).select("file_id").limit(101).agg(F.count("*").alias("n"))


@query("mail_all_words", f"SELECT file_id FROM messages WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'of')")
def mail_all_words(c: Corpus):
    return c.messages.filter(mail.all_words(F.col("text"), ["the", "of"])).select("file_id")


@query("mail_passage_exists", "SELECT mail_id FROM messages m WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(m.text, chr(10))) AS line) WHERE contains(lower(line), 'the ') AND length(line) > 80)")
def mail_passage_exists(c: Corpus):
    lines = c.messages.select("mail_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.lower("line").contains("the ") & (F.length("line") > 80))
    return c.messages.select("mail_id").join(lines, "mail_id", "left_semi")


@query("mail_conversation", "SELECT conversation, file_id, turn, substr(text, 1, 2000) AS opening FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY turn DESC) AS r FROM messages) WHERE r <= 26")
def mail_conversation(c: Corpus):
    last = F.row_number().over(Window.partitionBy("conversation").orderBy(F.desc("turn")))
    return c.messages.withColumn("r", last).filter("r <= 26").select("conversation", "file_id", "turn", F.substring("text", 1, 2000).alias("opening"))


@query("mail_dupes", "SELECT file_id, keep_id, CASE WHEN has_attach THEN path || '/attachments/' || attachment END AS attachment FROM (SELECT *, min(file_id) OVER (PARTITION BY archive, md5(text), subject, sender, sent_at) AS keep_id FROM copies) WHERE file_id <> keep_id")
def mail_dupes(c: Corpus):
    return mail.duplicates(_copies(c))


@query("mail_live_copies", "SELECT l.file_id AS live_id, a.file_id AS archive_id FROM (SELECT file_id, lower(message_id) AS k FROM messages WHERE conversation % 4 = 0) l JOIN (SELECT min(file_id) AS file_id, lower(message_id) AS k FROM messages WHERE turn % 2 = 0 GROUP BY 2) a ON l.k = a.k")
def mail_live_copies(c: Corpus):
    live = c.messages.filter("conversation % 4 = 0").withColumn("message_id", F.lower("message_id"))
    return mail.live_copies(live, c.messages.filter("turn % 2 = 0"))


@query("mail_folder_counts", "SELECT CASE WHEN conversation % 5 = 0 THEN 'account://user@example.com' ELSE archive END AS archive, folder, count(*) AS n FROM messages GROUP BY 1, 2")
def mail_folder_counts(c: Corpus):
    live = mail.account_path(F.lit("user@example.com"), F.col("folder"), F.col("file_id").cast("string"))
    rows = c.messages.withColumn("path", F.when(F.col("conversation") % 5 == 0, live).otherwise(F.col("path")))
    return mail.folder_counts(rows)


@query("account_mail_space", "SELECT 'account://user@example.com' AS account, count(DISTINCT file_id) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM messages WHERE conversation % 5 = 0")
def account_mail_space(c: Corpus):
    live = mail.account_path(F.lit("user@example.com"), F.col("folder"), F.col("file_id").cast("string"))
    rows = c.messages.filter("conversation % 5 = 0").withColumn("path", live)
    account, _ = mail.account_of(F.col("path"))
    return rows.groupBy(F.concat(F.lit(mail.ACCOUNT), account).alias("account")).agg(F.countDistinct("file_id").alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("mail_details_of_attachments", f"SELECT p.id, m.mail_id, m.sender, m.subject FROM (SELECT id, path FROM listing WHERE contains(path, '/attachments/') ORDER BY id LIMIT 50) p JOIN messages m ON m.path = split_part(p.path, '/attachments/', 1) WHERE p.id >= {ATTACHMENT_ID}")
def mail_details_of_attachments(c: Corpus):
    page = c.listing.filter(F.col("path").contains("/attachments/")).select("id", F.substring_index("path", "/attachments/", 1).alias("path")).orderBy("id").limit(50)
    return page.join(c.messages.select("path", "mail_id", "sender", "subject"), "path").select("id", "mail_id", "sender", "subject")


@query("mail_attachments", "SELECT path || '/attachments/' || attachment AS path, path AS message, attachment AS name FROM messages WHERE has_attach")
def mail_attachments(c: Corpus):
    parts = c.listing.filter(F.col("path").contains("/attachments/"))
    return parts.select("path", F.substring_index("path", "/attachments/", 1).alias("message"), F.substring_index("path", "/attachments/", -1).alias("name"))


@query("mail_metadata", "SELECT mail_id, sender, array_to_string(recipients, ';') AS recipients, subject, sent_at, folder FROM messages WHERE mail_id IN (SELECT mail_id FROM messages WHERE has_attach AND turn % 2 = 1)")
def mail_metadata(c: Corpus):
    asked = c.messages.filter("has_attach and turn % 2 = 1").select("mail_id")
    return c.messages.join(asked, "mail_id", "left_semi").select("mail_id", "sender", F.array_join("recipients", ";").alias("recipients"), "subject", "sent_at", "folder")


@query("mail_files", "SELECT m.file_id, f.path, m.sender FROM messages m JOIN listing f ON f.id = m.mail_id")
def mail_files(c: Corpus):
    return c.messages.select("file_id", "mail_id", "sender").join(c.listing.select(F.col("id").alias("mail_id"), "path"), "mail_id").select("file_id", "path", "sender")


@query("message_ids", "SELECT file_id, lower(trim(regexp_replace(message_id, '[<>]', '', 'g'))) AS k FROM messages")
def message_ids(c: Corpus):
    return c.messages.select("file_id", mail.message_key(F.col("message_id")).alias("k"))


@query("mail_header_match", "SELECT file_id FROM messages WHERE contains(lower(subject), 'sation 1') OR contains(lower(sender), 'ssist')")
def mail_header_match(c: Corpus):
    return c.messages.filter(T.contains_ci(F.col("subject"), "SATION 1") | T.contains_ci(F.col("sender"), "ssist")).select("file_id")


@query("address_in", "SELECT file_id, sender = 'user@example.com' AS whole, false AS part FROM messages")
def address_in(c: Corpus):
    text = F.concat(F.lit("From: "), "sender", F.lit(", jo"), "sender", F.lit(" x"))
    return c.messages.select("file_id", T.whole_address(text, "user@example.com").alias("whole"), T.whole_address(text, "ser@example.com").alias("part"))


@query("activity_with", "SELECT count_if(list_contains(recipients, 'user@example.com')) AS sent_to, count_if(sender = 'user@example.com') AS received, min(sent_at) AS first, max(sent_at) AS last, count_if(has_attach) AS attachments FROM messages")
def activity_with(c: Corpus):
    return mail.activity(c.messages, ["User@Example.com"])


@query("sender_months", "SELECT sender, strftime(make_timestamp(sent_at * 1000000), '%Y%m') AS month, count(*) AS n FROM messages WHERE sent_at IS NOT NULL GROUP BY 1, 2")
def sender_months(c: Corpus):
    month = F.date_format(F.timestamp_seconds("sent_at"), "yyyyMM")
    return c.messages.filter("sent_at is not null").groupBy("sender", month.alias("month")).agg(F.count("*").alias("n"))


# ---- contacts

NAMED = "lower(trim(regexp_replace(replace(name, '#', ' '), '\\s+', ' ', 'g')))"


@query("contact_duplicates", "SELECT id, min(id) OVER (PARTITION BY name) AS component, CAST(0.97 AS DOUBLE) AS confidence, true AS safe, array_to_string(list_sort(list_filter(['same email', CASE WHEN m > m1 THEN 'same phone' END], lambda x: x IS NOT NULL)), ', ') AS reasons FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n, count(CASE WHEN mobile THEN phone END) OVER (PARTITION BY name) AS m, (SELECT count(DISTINCT phone) FROM cards d WHERE d.mobile AND d.name = cards.name) AS m1 FROM cards) WHERE n > 1")
def contact_duplicates(c: Corpus):
    return contacts.duplicates(_cards(c))


WEAK = "SELECT id, lower(replace(name, '#', ' ')) AS k, company FROM cards WHERE id % 50 = 0"


@query("contact_suggestions", f"SELECT id, min(id) OVER (PARTITION BY k) AS component, CASE WHEN pairs > 0 THEN CAST(0.70 AS DOUBLE) ELSE CAST(0.50 AS DOUBLE) END AS confidence, false AS safe FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n, count(*) OVER (PARTITION BY k) - (SELECT count(DISTINCT company) FROM ({WEAK}) w WHERE w.k = v.k) AS pairs FROM ({WEAK}) v) WHERE n > 1")
def contact_suggestions(c: Corpus):
    # Without addresses and numbers, names and companies only suggest.
    bare = _cards(c).filter("id % 50 = 0").withColumns({"email": F.lit(None).cast("string"), "phone": F.lit(None).cast("string")})
    return contacts.duplicates(bare).select("id", "component", "confidence", "safe")


@query("contact_merge", "SELECT email AS g, min(id) AS id, arg_min(name, id) AS name, arg_min(company, id) FILTER (company <> '') AS company, email AS emails, coalesce(string_agg(DISTINCT phone, ',' ORDER BY phone), '') AS phones, count(*) AS n, bool_or(favourite) AS favourite, count(DISTINCT company) > 1 AS conflict FROM cards GROUP BY email")
def contact_merge(c: Corpus):
    return contacts.merged(_cards(c).withColumn("g", F.col("email")), "g")


@query("contacts_without_phone", "SELECT id, name FROM cards WHERE phone IS NULL AND NOT favourite ORDER BY lower(name), id LIMIT 200")
def contacts_without_phone(c: Corpus):
    return _cards(c).filter("phone is null and not favourite").select("id", "name").orderBy(F.lower("name"), "id").limit(200)


@query("contacts_of_company", "SELECT id, name FROM cards WHERE lower(company) = 'machinery' AND favourite")
def contacts_of_company(c: Corpus):
    return _cards(c).filter((F.lower("company") == "machinery") & F.col("favourite")).select("id", "name")


@query("contacts_not_heard_of", "SELECT c_custkey AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '1998-08-02' - INTERVAL 400 DAY")
def contacts_not_heard_of(c: Corpus):
    last = c.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last"))
    rows = c.table("customer").select(F.col("c_custkey").alias("id")).join(last, "id", "left")
    return rows.filter("last is null or last < timestamp_ntz'1998-08-02' - interval '400' day").select("id")


@query("contacts_in_query", "SELECT id, name FROM cards WHERE length(name) >= 3 AND contains('invoices from customer#000000012 and supplier zero', lower(name))")
def contacts_in_query(c: Corpus):
    return contacts.named_in(_cards(c), "Invoices from Customer#000000012 and Supplier Zero").select("id", "name")


JOURNAL = "SELECT id, 1 AS seq, id % 4 AS batch, name AS before, upper(name) AS after FROM contacts UNION ALL SELECT id, 2, 2, upper(name), name || ' II' FROM contacts WHERE id % 3 = 0"


@query("contact_undo", f"SELECT id, CASE WHEN count_if(batch = 2) > 0 THEN arg_min(before, seq) FILTER (batch = 2) ELSE arg_max(after, seq) END AS value FROM ({JOURNAL}) GROUP BY 1")
def contact_undo(c: Corpus):
    own = c.contacts.select("id", F.lit(1).alias("seq"), (F.col("id") % 4).cast("int").alias("batch"), F.col("name").alias("before"), F.upper("name").alias("after"))
    more = c.contacts.filter("id % 3 = 0").select("id", F.lit(2).alias("seq"), F.lit(2).alias("batch"), F.upper("name").alias("before"), F.concat("name", F.lit(" II")).alias("after"))
    return contacts.reverted(own.unionByName(more), 2)


@query("merge_batches", "SELECT id % 4 AS batch, min(id) AS first_id, count(*) AS n FROM contacts GROUP BY 1")
def merge_batches(c: Corpus):
    return c.contacts.groupBy((F.col("id") % 4).alias("batch")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


CASED = "CASE id % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE 'Mc' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) END"


@query("contact_name_case", f"SELECT id, array_to_string(list_transform(string_split(n, ' '), lambda w: CASE WHEN w = lower(w) OR (w = upper(w) AND length(w) > 1) THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE w END), ' ') AS fixed FROM (SELECT id, {CASED} AS n FROM (SELECT p_partkey AS id, p_name FROM part))")
def contact_name_case(c: Corpus):
    i, n = F.col("p_partkey"), F.col("p_name")
    cased = F.when(i % 3 == 0, F.upper(n)).when(i % 3 == 1, n).otherwise(F.concat(F.lit("Mc"), F.upper(F.substring(n, 1, 1)), F.expr("substring(p_name, 2)")))
    return c.table("part").select(i.alias("id"), T.name_case(cased).alias("fixed"))


@query("contact_sort_key", "SELECT id, CASE WHEN len(w) < 2 THEN lower(name) ELSE w[-1] || ', ' || array_to_string(w[1:len(w) - 1], ' ') END AS k FROM (SELECT id, name, regexp_split_to_array(lower(name), ' +') AS w FROM contacts)")
def contact_sort_key(c: Corpus):
    return c.contacts.select("id", T.sort_key(F.col("name")).alias("k"))


HOSTS = "CASE id % 5 WHEN 0 THEN 'jo@mail.acme-widgets.co.uk' WHEN 1 THEN 'x@gmail.com' WHEN 2 THEN 'a@big' || id || '-firm.de' WHEN 3 THEN 'no address' ELSE 'y@' || id || '.example.org' END"


@query("contact_company_guess", "SELECT id, CASE id % 5 WHEN 0 THEN 'Acme Widgets' WHEN 2 THEN 'Big' || id || ' Firm' WHEN 4 THEN 'Example' END AS company FROM contacts")
def contact_company_guess(c: Corpus):
    i, s = F.col("id"), F.col("id").cast("string")
    email = F.when(i % 5 == 0, "jo@mail.acme-widgets.co.uk").when(i % 5 == 1, "x@gmail.com").when(i % 5 == 2, F.concat(F.lit("a@big"), s, F.lit("-firm.de"))).when(i % 5 == 3, "no address").otherwise(F.concat(F.lit("y@"), s, F.lit(".example.org")))
    return c.contacts.select("id", contacts.company_guess(email).alias("company"))


@query("contact_field_copies", "SELECT id, phone FROM cards WHERE phone IS NOT NULL AND id % 2 = 0")
def contact_field_copies(c: Corpus):
    # A card with its number once more in other spacing: the copy is found by the number's key.
    rows = _cards(c).filter("phone is not null")
    fields = rows.select("id", "phone", F.explode(F.array("phone", F.when(F.col("id") % 2 == 0, F.replace("phone", F.lit(" "), F.lit(""))))).alias("value")).filter("value is not null")
    same = fields.groupBy("id", T.phone_key(F.col("value")).alias("k")).agg(F.count("*").alias("n"), F.min("phone").alias("phone"))
    return same.filter("n > 1").select("id", "phone")


@query("import_matches", "SELECT phone AS k, min(id) AS first_id, count(*) AS n FROM cards WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def import_matches(c: Corpus):
    return _cards(c).filter("phone is not null").groupBy(F.col("phone").alias("k")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query("contact_piles", "SELECT k.id, p.id AS pile FROM (SELECT id, CASE WHEN id % 100 < 10 THEN 'PERSON  ' || (id % 10) ELSE name END AS name FROM contacts) k JOIN piles p ON lower(regexp_replace(k.name, '\\s+', ' ', 'g')) = lower(p.name)".replace("\\\\", "\\"))
def contact_piles(c: Corpus):
    named = F.when(F.col("id") % 100 < 10, F.concat(F.lit("PERSON  "), (F.col("id") % 10).cast("string"))).otherwise(F.col("name"))
    cards = c.contacts.select("id", contacts.folded(named).alias("k"))
    return cards.join(c.piles.select(F.col("id").alias("pile"), contacts.folded(F.col("name")).alias("k")), "k").select("id", "pile")


PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@query("signature_phones", f"WITH r AS (SELECT source, doc_id, regexp_extract(text, '{PHONE}') AS phone FROM documents WHERE regexp_matches(text, '{PHONE}')), n AS (SELECT source, arg_max(phone, doc_id) AS phone FROM r GROUP BY 1) SELECT n.source, n.phone, count(*) AS seen, round(CAST(least(0.97, 0.6 + least(0.3, 0.1 * (count(*) - 1))) AS DOUBLE), 6) AS confidence FROM n JOIN r ON r.source = n.source AND r.phone = n.phone GROUP BY 1, 2")
def signature_phones(c: Corpus):
    # The newest number of each source is offered; others that agree make it surer, up to 0.97.
    found = c.table("documents").select("source", "doc_id", F.regexp_extract("text", PHONE, 0).alias("phone")).filter("phone != ''")
    newest = found.groupBy("source").agg(F.max_by("phone", "doc_id").alias("phone"))
    seen = found.join(newest, ["source", "phone"]).groupBy("source", "phone").agg(F.count("*").alias("seen"))
    return seen.withColumn("confidence", F.round(F.least(F.lit(0.97), 0.6 + F.least(F.lit(0.3), 0.1 * (F.col("seen") - 1))), 6))


@query("account_counts", "SELECT c_nationkey AS account, count(*) AS n, count_if(c_acctbal < 0) AS held, count_if(c_acctbal >= 0) AS synced FROM customer GROUP BY 1")
def account_counts(c: Corpus):
    b = F.col("c_acctbal")
    return c.table("customer").groupBy(F.col("c_nationkey").alias("account")).agg(F.count("*").alias("n"), F.count_if(b < 0).alias("held"), F.count_if(b >= 0).alias("synced"))


CHANGED = "SELECT c_nationkey AS account, c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'name' WHEN c_custkey % 7 = 0 THEN 'phone' ELSE 'same' END AS shape FROM customer"


@query("churn_brake", f"WITH t AS (SELECT account, shape, count(*) AS n FROM ({CHANGED}) GROUP BY 1, 2) SELECT account, CAST(sum(n) FILTER (shape <> 'same') AS BIGINT) AS changed, coalesce(sum(n) FILTER (shape <> 'same') >= 10 AND max(n) FILTER (shape <> 'same') * 100 >= 20 * sum(n), false) AS held FROM t GROUP BY 1")
def churn_brake(c: Corpus):
    # Held if 10 or more changed and the commonest change is that of 20 in a hundred of the account's contacts.
    key = F.col("c_custkey")
    shape = F.when(key % 5 == 0, "name").when(key % 7 == 0, "phone").otherwise("same")
    each = c.table("customer").groupBy(F.col("c_nationkey").alias("account"), shape.alias("shape")).agg(F.count("*").alias("n"))
    changed = F.when(F.col("shape") != "same", F.col("n"))
    held = F.coalesce((F.sum(changed) >= 10) & (F.max(changed) * 100 >= 20 * F.sum("n")), F.lit(False))
    return each.groupBy("account").agg(F.sum(changed).alias("changed"), held.alias("held"))


@query("mass_delete_brake", "SELECT c_nationkey AS account, count_if(c_custkey % 3 = 0) AS gone, count(*) AS n, count_if(c_custkey % 3 = 0) * 3 > count(*) AND count(*) > 5 AS held FROM customer GROUP BY 1")
def mass_delete_brake(c: Corpus):
    gone, n = F.count_if(F.col("c_custkey") % 3 == 0), F.count("*")
    return c.table("customer").groupBy(F.col("c_nationkey").alias("account")).agg(gone.alias("gone"), n.alias("n"), ((gone * 3 > n) & (n > 5)).alias("held"))


@query("contact_csv", "SELECT id, '\"' || replace(name, '\"', '\"\"') || '\",' || email || ',' || coalesce(phone, '') AS line FROM cards")
def contact_csv(c: Corpus):
    name = F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('",'))
    return _cards(c).select("id", F.concat(name, "email", F.lit(","), F.coalesce("phone", F.lit(""))).alias("line"))


@query("contact_units", "SELECT id, 'email=' || email || ';name=' || name || CASE WHEN phone IS NOT NULL THEN ';phone=' || phone ELSE '' END AS units FROM cards")
def contact_units(c: Corpus):
    # A card as a map of its units, written out in order of their keys.
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("phone", "name", "email")]), lambda x: x["value"].isNotNull())
    units = F.map_from_entries(pairs)
    return _cards(c).select("id", F.array_join(F.transform(F.array_sort(F.map_entries(units)), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("units"))

