"""Signatures: tails of messages, their details, and what a customer's messages agree on; cards of one person.

An order stands for a message of its customer, signed with details that change with the years; every sixth is
only known as a quotation in somebody else's message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import same_person, signatures
from brindle.queries.registry import query
from brindle.sources.corpus import SQL_VIEWS, Corpus

TITLES = ("Senior Engineer", "Sales Manager", "Finance Director")

SQL_VIEWS["letters"] = f"SELECT k AS message, p, n AS name, 'customer' || p || '@example.com' AS person, k % 6 = 0 AS quoted, k % 3 <> 0 AS name_line, CASE WHEN k % 17 <> 0 OR k % 6 = 0 THEN (d - DATE '1970-01-01') * 86400 + k % 1440 * 60 END AS sent_at, strftime(d, '%Y-%m-%d') || ' ' || lpad(CAST(k % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') AS stamp, {list(TITLES)}[CAST((p + year(d)) % 3 + 1 AS INT)] AS title, CASE WHEN k % 5 <> 0 THEN s[1] || lower(s[2:]) || ' Ltd' END AS company, CASE WHEN k % 4 <> 0 THEN '+44 20 7946 ' || (1000 + p % 9000) END AS tel, CASE WHEN k % 7 = 0 THEN '+44 7700 900' || (100 + year(d) % 50) END AS mobile FROM (SELECT o_orderkey AS k, o_custkey AS p, CAST(o_orderdate AS DATE) AS d, c_name AS n, c_mktsegment AS s FROM orders JOIN customer ON c_custkey = o_custkey)"
SQL_VIEWS["signed"] = "SELECT *, concat_ws(chr(10), '-- ', CASE WHEN name_line THEN name END, title, company, 'Tel: ' || tel, 'Mobile: ' || mobile, person) AS sig FROM letters"


def _letters(c: Corpus) -> DataFrame:
    """(message, person, name, sent_at, text)."""
    k, p, d = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    number = lambda x: x.cast("long").cast("string")
    sent = F.unix_date(d).cast("long") * 86400 + k % 1440 * 60
    stamp = F.concat(F.date_format(d, "yyyy-MM-dd "), F.lpad(number(F.floor(k % 1440 / 60)), 2, "0"), F.lit(":"), F.lpad(number(k % 60), 2, "0"))
    person = F.concat(F.lit("customer"), number(p), F.lit("@example.com"))
    title = F.element_at(F.lit(list(TITLES)), ((p + F.year(d)) % 3 + 1).cast("int"))
    sig = F.concat_ws(
        "\n", F.lit("-- "), F.when(k % 3 != 0, F.col("c_name")), title, F.when(k % 5 != 0, F.concat(F.initcap("c_mktsegment"), F.lit(" Ltd"))),
        F.when(k % 4 != 0, F.concat(F.lit("Tel: +44 20 7946 "), number(1000 + p % 9000))),
        F.when(k % 7 == 0, F.concat(F.lit("Mobile: +44 7700 900"), number(100 + F.year(d) % 50))), person,
    )
    own = F.concat(F.col("o_orderpriority"), F.lit("\n"), sig)
    citing = F.concat(F.lit("See below.\n-----Original Message-----\nFrom: "), "c_name", F.lit(" <"), person, F.lit(">\nSent: "), stamp, F.lit("\nTo: desk\n\n"), own)
    quoted = k % 6 == 0
    rows = c.table("orders").join(c.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    return rows.select(
        k.alias("message"), F.when(quoted, "desk@example.com").otherwise(person).alias("person"), F.when(quoted, "Desk").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 17 != 0, sent).alias("sent_at"), F.when(quoted, citing).otherwise(own).alias("text"),
    )


TAIL = "CASE WHEN quoted THEN concat('-----Original Message-----', chr(10), 'From: ', name, ' <', person, '>', chr(10), 'Sent: ', stamp, chr(10), 'To: desk', chr(10), chr(10), o_orderpriority, chr(10), sig) ELSE sig END"


@query("message_tails", f"SELECT message, CASE WHEN quoted THEN 'quote' ELSE 'signature' END AS reason, md5({TAIL}) AS h FROM signed JOIN orders ON o_orderkey = message WHERE message % 10 <> 0 UNION ALL SELECT message, 'quote', md5('> old') FROM letters WHERE message % 20 = 0")
def message_tails(c: Corpus):
    # All messages are read; then every tenth again, half of them with another tail, half without one.
    first = signatures.tails(_letters(c))
    again = c.table("orders").join(c.table("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").filter("o_orderkey % 10 = 0")
    text = F.when(F.col("o_orderkey") % 20 == 0, "new words\n> old").otherwise("new words")
    second = signatures.tails(again.select(F.col("o_orderkey").alias("message"), text.alias("text")))
    return signatures.keep_tails(first, second).select("message", "reason", F.md5(F.col("tail").cast("binary")).alias("h"))


DETAILS = "SELECT message, person, sent_at, quoted, name_line, unnest(['title', 'company', 'phone:work', 'phone:mobile', 'email:' || person]) AS slot, unnest([title, company, tel, mobile, person]) AS value FROM letters"


@query("signature_details", f"SELECT message, person, quoted, name_line, slot, value FROM ({DETAILS}) WHERE value IS NOT NULL")
def signature_details(c: Corpus):
    found = signatures.said(signatures.blocks(_letters(c)))
    return found.select("message", "person", "quoted", "name_line", "slot", "value")


@query("contact_consensus", f"""WITH s AS (SELECT *, row(coalesce(sent_at, -1), message) AS o FROM ({DETAILS}) WHERE value IS NOT NULL),
lt AS (SELECT person, max(row(coalesce(sent_at, -1), message)) AS newest FROM letters GROUP BY 1),
k AS (SELECT person, slot, value, max(o) AS o, max(sent_at) AS last_at, count(*) AS seen, min(sent_at) AS first_seen, bool_or(NOT quoted) AS direct, arg_max(message, row(NOT quoted, o)) AS message, arg_max(name_line, row(NOT quoted, o)) AS name_line FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY person, slot ORDER BY o DESC) AS place FROM k),
h AS (SELECT person, slot, string_agg('was ' || value || ' until ' || coalesce(strftime(to_timestamp(last_at) AT TIME ZONE 'UTC', '%B %Y'), 'an undated message'), '; ' ORDER BY place) AS history FROM r WHERE place IN (2, 3) GROUP BY 1, 2)
SELECT r.person, r.slot, r.value, r.message, r.seen, r.first_seen, least(97, 60 + CASE WHEN name_line THEN 20 ELSE 0 END + least(30, 10 * (seen - 1)) - CASE WHEN lt.newest > r.o THEN 20 ELSE 0 END - CASE WHEN direct THEN 0 ELSE 15 END) / 100 AS confidence, coalesce(history, '') AS history FROM r JOIN lt USING (person) LEFT JOIN h USING (person, slot) WHERE place = 1""")
def contact_consensus(c: Corpus):
    return signatures.consensus(signatures.blocks(_letters(c)))


GIVEN, FAMILY = ("Ann", "A.", "Robert", "Rob", "Cy", "Ann Marie", ""), ("Lee", "Lee-Roe", "Yusof", "Bin Yusof", "")


def book(c: Corpus) -> DataFrame:
    """Cards of customers: some pairs share a name, a company, an address or a number, and some hold but their name."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p.cast("long").cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    of = lambda values, n: F.element_at(F.lit(list(values)), (n % len(values) + 1).cast("int"))
    bare, pair = k % 13 == 0, 100000 + F.floor(k / 20)
    number = F.when(k % 10 == 1, text("+44 7700 ", pair)).when(k % 10 == 2, text("+44 20 ", pair)).when(k % 10 == 3, text("020 ", pair))
    emails = F.filter(F.array(F.when(k % 6 == 0, text("m", F.floor(k / 12), "@x.org")), F.when(k % 9 == 4, text("m", F.floor(k / 18), "@y.org"))), lambda e: e.isNotNull())
    return c.table("customer").select(
        k.alias("id"), of(GIVEN, k).alias("given"), F.when(k % 4 == 0, F.col("c_name")).alias("additional"),
        F.concat_ws(" ", of(FAMILY, F.floor(k / 14)), text("f", F.floor(k / 14))).alias("family"), F.when(~bare & (k % 3 != 0), text("Firm ", F.floor(k / 14))).alias("company"),
        F.when(~bare, emails).alias("emails"), F.when(~bare & number.isNotNull(), F.array(F.struct(number.alias("value"), (k % 10 == 1).alias("mobile")))).alias("phones"), bare.alias("bare"),
    )


def rejections(c: Corpus) -> DataFrame:
    return c.table("customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + F.when(F.col("c_custkey") % 20 == 0, 7).otherwise(6)).alias("b"))


@query("contact_same_person")
def contact_same_person(c: Corpus):
    # tests/test_same_person.py holds it against all pairs.
    shared = c.table("customer").filter("c_custkey % 40 = 0").select(F.concat(F.lit("email:m"), F.floor(F.col("c_custkey") / 18).cast("string"), F.lit("@y.org")).alias("value"))
    return same_person.duplicates(book(c), rejections(c), shared)


PEOPLE = "SELECT c_custkey // 3 AS grp, c_custkey AS id, c_custkey % 3 AS place, c_name, c_mktsegment, c_nationkey FROM customer"


@query("contact_merge_fields", f"""WITH p AS ({PEOPLE}), one AS (SELECT grp, 'company' AS field, id, place, c_mktsegment AS value, id % 9 = 2 AS pick FROM p WHERE id % 5 <> 0 UNION ALL SELECT grp, 'notes', id, place, 'from ' || c_nationkey % 3, false FROM p),
s AS (SELECT grp, field, count(DISTINCT value) > 1 AS conflict, coalesce(max(value) FILTER (pick), arg_min(value, place)) AS first, list(value ORDER BY place) AS vs, list(struct_pack(id := id, value := value) ORDER BY place) AS held FROM one GROUP BY 1, 2)
SELECT grp, field, CAST(NULL AS VARCHAR) AS key, CASE WHEN field = 'notes' THEN array_to_string(list_transform(list_filter(list_transform(vs, lambda v, i: CASE WHEN list_position(vs, v) = i THEN v END), lambda v: v IS NOT NULL), lambda v: v), chr(10) || chr(10)) ELSE first END AS value, CAST(NULL AS VARCHAR) AS label, false AS main,
 list_transform(list_filter(held, lambda h: field = 'notes' OR h.value = first), lambda h: h.id) AS ids, conflict FROM s
UNION ALL SELECT grp, 'email', key, arg_min(value, place), arg_min(label, place) FILTER (label <> ''), bool_or(main), list(id ORDER BY place), false FROM (SELECT grp, id, place, 'n' || c_nationkey % 2 AS key, CASE WHEN id % 2 = 0 THEN 'n' ELSE 'N' END || c_nationkey % 2 AS value, CASE WHEN id % 3 = 1 THEN 'work' ELSE '' END AS label, id % 4 = 0 AS main FROM p) GROUP BY grp, key""")
def contact_merge_fields(c: Corpus):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    rows = c.table("customer").select(F.floor(k / 3).alias("grp"), k.alias("id"), (k % 3).alias("place"), "c_mktsegment", "c_nationkey")
    i, even = F.col("id"), (nation % 2).cast("string")
    unit = lambda field, many, key, value, label, main: F.struct(F.lit(field).alias("field"), F.lit(many).alias("many"), key.alias("key"), value.alias("value"), label.alias("label"), main.alias("main"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    units = F.array(
        unit("company", False, none, F.when(i % 5 != 0, F.col("c_mktsegment")).otherwise(" "), none, no), unit("notes", False, none, F.concat(F.lit("from "), (nation % 3).cast("string")), none, no),
        unit("email", True, F.concat(F.lit("n"), even), F.concat(F.when(i % 2 == 0, "n").otherwise("N"), even), F.when(i % 3 == 1, "work").otherwise(""), i % 4 == 0),
    )
    choices = rows.filter("id % 9 = 2").select("grp", F.lit("company").alias("field"), "id")
    return same_person.merged(rows.select("grp", "id", "place", F.explode(units).alias("u")).select("grp", "id", "place", "u.*"), choices)


@query("contact_undo_fields", "SELECT c_custkey AS id, 'name' AS field, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_name ELSE CASE WHEN c_custkey % 3 = 0 THEN 'later' WHEN c_custkey % 2 = 0 THEN 'merged' ELSE c_name END END AS value, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 <> 0 END AS taken_back FROM customer UNION ALL SELECT c_custkey, 'company', c_mktsegment, true FROM customer WHERE c_custkey % 4 = 0")
def contact_undo_fields(c: Corpus):
    # Batch 7 renamed every second card and took every fourth one's company; names of every third were changed since.
    k = F.col("c_custkey")
    rows = c.table("customer").select(k.alias("id"), "c_name", "c_mktsegment")
    i = F.col("id")
    now = rows.select("id", F.lit("name").alias("field"), F.when(i % 3 == 0, "later").when(i % 2 == 0, "merged").otherwise(F.col("c_name")).alias("value"))
    entry = lambda batch, seq, field, before, after: [F.lit(batch).alias("batch"), F.lit(seq).alias("seq"), "id", F.lit(field).alias("field"), before.alias("before"), after.cast("string").alias("after")]
    journal = rows.filter(i % 2 == 0).select(*entry(7, 1, "name", F.col("c_name"), F.lit("first try"))).unionByName(rows.filter(i % 2 == 0).select(*entry(7, 2, "name", F.lit("first try"), F.lit("merged"))))
    journal = journal.unionByName(rows.filter(i % 4 == 0).select(*entry(7, 3, "company", F.col("c_mktsegment"), F.lit(None)))).unionByName(rows.filter(i % 3 == 0).select(*entry(8, 4, "name", F.lit("merged"), F.lit("later"))))
    return same_person.undone(now, journal, 7)
