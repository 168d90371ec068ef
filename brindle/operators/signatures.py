"""Signatures in mail: what is cut from a message, the details it holds, and what a person's messages agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators.contacts import folded

ORIGINAL = r"(?m)^-{3,} ?Original Message ?-{3,}[ \t]*$\n?"
REPLY = r"(?m)^(?:-{3,} ?Original Message ?-{3,}|On .* wrote:|>.*)[ \t]*$"
#: A signature's line is shorter than this; a longer one is running text, and ends it.
LONGEST_LINE = 90
JOBS = ("accountant", "administrator", "adviser", "agent", "analyst", "architect", "assistant", "buyer", "chairman", "clerk", "consultant", "coordinator", "designer", "developer", "director", "editor", "engineer", "lawyer", "lecturer", "librarian", "manager", "nurse", "officer", "operator", "partner", "president", "producer", "professor", "researcher", "scientist", "secretary", "solicitor", "surveyor", "teacher", "technician", "trainer", "treasurer", "writer")
FORMS = ("ab", "ag", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "kg", "limited", "llc", "llp", "ltd", "nv", "oy", "oyj", "plc", "pty", "sa", "sarl", "spa", "srl")
PHONE = r"(?:^|[^0-9A-Za-z+])(\+?[0-9][0-9 ().-]{5,}[0-9])(?![0-9A-Za-z])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SITE = r"(?i)(?:^|\s)((?:https?://|www\.)[^\s<>]*[^\s<>.,;:)])"

# Fixed values, in hundredths: how sure an agreed value is.
BASE, NAME_LINE, EACH_OTHER, MOST_OTHERS, NEWER_LACKS, QUOTED, MOST = 60, 20, 10, 30, 20, 15, 97


def _at(c: Column, mark: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_instr(c, F.lit(mark)), F.lit(0)), F.length(c) + 1)


def tails(mails: DataFrame) -> DataFrame:
    """(message, tail, reason) of (message, text): all from the first mark of a signature or an earlier message on.

    The reason is signature or quote; without a mark, or without a text, both are empty.
    """
    c = F.coalesce("text", F.lit(""))
    sign, reply = _at(c, T.SIGNATURE_MARKS), _at(c, REPLY)
    tail = F.substring(c, F.least(sign, reply), F.length(c))
    return mails.select("message", tail.alias("tail"), F.when(tail == "", "").when(sign < reply, "signature").otherwise("quote").alias("reason"))


def keep_tails(kept: DataFrame, read: DataFrame) -> DataFrame:
    """The kept tails after messages were read again: theirs are replaced, or go where nothing is cut any more."""
    return kept.join(read.select("message"), "message", "left_anti").unionByName(read.filter("tail != ''"))


def blocks(mails: DataFrame) -> DataFrame:
    """(message, part, person, name, sent_at, quoted, block, name_line) for each signature in mails.

    mails: message, person (an address), name, sent_at (seconds or null), text. Each message that a mail quotes
    under a line of its own is a part, of the person and time in its From and Sent lines; without an address there,
    it is nobody's and left out. What follows a reply's opening or a quoted line is not read.
    """
    part = mails.select("message", "person", "name", "sent_at", F.posexplode(F.split(F.coalesce("text", F.lit("")), ORIGINAL)).alias("part", "body"))
    head = lambda p: F.regexp_extract("body", p, 1)
    own, stamp = F.col("part") == 0, r"(?m)^Sent:[ \t]*{}[ \t]*$"
    date = F.try_to_date(head(stamp.format(r"(\d{4}-\d\d-\d\d) \d\d:\d\d")), "yyyy-MM-dd")
    clock = lambda p: head(stamp.format(p)).try_cast("long")
    sent = F.unix_date(date).cast("long") * 86400 + clock(r"\d{4}-\d\d-\d\d (\d\d):\d\d") * 3600 + clock(r"\d{4}-\d\d-\d\d \d\d:(\d\d)") * 60
    said = part.select(
        "message", "part", (~own).alias("quoted"),
        F.when(own, F.lower("person")).otherwise(F.lower(head(r"(?m)^From:.*<([^<>\s]+@[^<>\s]+)>[ \t]*$"))).alias("person"),
        F.when(own, F.col("name")).otherwise(F.trim(head(r"(?m)^From:([^<\n]*)<"))).alias("name"),
        F.when(own, F.col("sent_at")).otherwise(sent).alias("sent_at"),
        F.substring("body", F.lit(1), _at(F.col("body"), REPLY) - 1).alias("body"),
    ).filter("person != ''")
    rest = F.regexp_replace(F.substring("body", _at(F.col("body"), T.SIGNATURE_MARKS), F.length("body")), r"\A[^\n]*\n?", "")
    lines = F.filter(F.transform(F.split(rest, r"\n|\s+[|•·]\s+"), lambda x: F.trim(T.normal_space(x))), lambda x: x != "")
    long = F.array_position(F.transform(lines, lambda x: F.length(x) > LONGEST_LINE), True)
    block = F.slice(lines, F.lit(1), F.when(long > 0, long - 1).otherwise(F.size(lines)).cast("int"))
    name = F.coalesce(folded(F.col("name")), F.lit(""))
    found = said.withColumn("block", block).filter(F.size("block") > 0)
    return found.withColumn("name_line", F.exists("block", lambda x: folded(x) == name)).drop("body")


def said(found: DataFrame) -> DataFrame:
    """(message, part, person, sent_at, quoted, name_line, slot, key, value): the details in blocks, cut from them.

    A line that is the person's name is no detail. Slots: title, company, website (the first line of each counts), phone:mobile, phone:fax, phone:work with :2, :3
    for further numbers of a kind, email:address. Keys are what values are compared by.
    """
    form, job = r"(?i)\b(?:{})\.?$".format("|".join(FORMS)), r"(?i)\b(?:{})s?\b".format("|".join(JOBS))
    unit = lambda slot, key, value: F.struct(slot.alias("slot"), key.alias("key"), value.alias("value"))

    def units(x: Column) -> Column:
        email, site, phone = F.lower(F.regexp_extract(x, EMAIL, 0)), F.regexp_extract(x, SITE, 1), F.regexp_extract(x, PHONE, 1)
        label = F.when(x.rlike(r"(?i)^(?:m|mob|mobile|cell)\b"), "phone:mobile").when(x.rlike(r"(?i)^(?:f|fax|telefax)\b"), "phone:fax").otherwise("phone:work")
        words = ~x.rlike(r"[0-9@]|(?i)www\.")
        bare = F.regexp_replace(F.lower(site), r"^(?:https?://)?(?:www\.)?|/+$", "")
        return F.array(
            F.when(email != "", unit(F.concat(F.lit("email:"), email), email, email)),
            F.when(site != "", unit(F.lit("website"), bare, site)),
            F.when((site == "") & T.phone_key(phone).isNotNull(), unit(label, T.phone_key(phone), phone)),
            F.when(words & x.rlike(form), unit(F.lit("company"), folded(x), x)).when(words & x.rlike(job), unit(F.lit("title"), folded(x), x)),
        )

    name = F.coalesce(folded(F.col("name")), F.lit(""))
    details = F.filter("block", lambda x: folded(x) != name)
    all_units = F.filter(F.flatten(F.transform(details, units)), lambda u: u.isNotNull())
    kept = ["message", "part", "person", "sent_at", "quoted", "name_line"]
    rows = found.select(*kept, F.posexplode(all_units).alias("at", "u")).select(*kept, "at", "u.*")
    nth = F.row_number().over(Window.partitionBy("message", "part", "slot").orderBy("at"))
    slot = F.when((nth == 1) | ~F.col("slot").startswith("phone:"), F.col("slot")).otherwise(F.concat_ws(":", "slot", nth))
    return rows.withColumn("nth", nth).withColumn("slot", slot).filter("nth = 1 or slot like 'phone:%'").drop("at", "nth")


def consensus(found: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(person, slot, value, message, seen, first_seen, confidence, history): a value a slot, the newest.

    Newest first is by time, undated last, then by the larger message and the nearer part. Messages that say the same
    make it surer, a newer signature without the slot or only quoted messages less sure. message is the newest that
    holds the value, one of the person's own before a quoted one. history tells the last two other values.
    """
    order = F.struct(F.col("sent_at").isNotNull().alias("dated"), F.coalesce("sent_at", F.lit(0)).alias("sent_at"), "message", (-F.col("part")).alias("part"))
    last = found.groupBy("person").agg(F.max(order).alias("last"))
    rows = (said(found) if details is None else details).withColumn("o", order)
    best = F.max(F.struct((~F.col("quoted")).alias("direct"), "o", "name_line", "value"))
    keys = rows.groupBy("person", "slot", "key").agg(
        F.max("o").alias("newest"), F.max_by("value", "o").alias("latest"), F.count("*").alias("seen"), F.min("sent_at").alias("first_seen"), best.alias("r"),
    )
    place = F.row_number().over(Window.partitionBy("person", "slot").orderBy(F.desc("newest")))
    top = keys.withColumn("place", place).filter("place <= 3")
    month = F.when(F.col("newest.dated"), F.date_format(F.date_from_unix_date(F.floor(F.col("newest.sent_at") / 86400).cast("int")), "MMMM yyyy")).otherwise("an undated message")
    was = F.when(F.col("place") > 1, F.struct("place", F.concat(F.lit("was "), "latest", F.lit(" until "), month).alias("text")))
    one = lambda c: F.max(F.when(F.col("place") == 1, F.col(c))).alias(c)
    agreed = top.groupBy("person", "slot").agg(
        one("newest"), one("seen"), one("first_seen"), one("r"),
        F.array_join(F.transform(F.sort_array(F.collect_list(was)), lambda x: x["text"]), "; ").alias("history"),
    )
    points = (
        F.lit(BASE) + F.when(F.col("r.name_line"), NAME_LINE).otherwise(0) + F.least(F.lit(MOST_OTHERS), EACH_OTHER * (F.col("seen") - 1))
        - F.when(F.col("last") > F.col("newest"), NEWER_LACKS).otherwise(0) - F.when(F.col("r.direct"), 0).otherwise(QUOTED)
    )
    sure = (F.least(F.lit(MOST), points) / 100).alias("confidence")
    return agreed.join(last, "person").select("person", "slot", F.col("r.value").alias("value"), F.col("r.o.message").alias("message"), "seen", "first_seen", sure, "history")
