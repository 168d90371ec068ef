"""Contacts: duplicates with confidences, merging, cleaning up, journals and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import graphs
from brindle.sources.store import kept

# How sure two cards are one person, by what they share.
CONFIDENCE = {
    "same email": 0.97, "same phone": 0.95, "same name, one holds nothing else": 0.92, "same landline and name": 0.75, "same name and company": 0.70,
    "same phone digits": 0.60, "same name": 0.50,
}
SAFE = ("same email", "same phone", "same name, one holds nothing else")
# Hosts that give anyone an address, and public suffixes of two labels; any other suffix is one label.
FREE_MAIL = ("aol.com", "example.com", "fastmail.com", "gmail.com", "gmx.de", "gmx.net", "hotmail.com", "icloud.com", "live.com", "mail.com", "me.com", "msn.com", "outlook.com", "proton.me", "protonmail.com", "web.de", "yahoo.co.uk", "yahoo.com", "yandex.com", "zoho.com")
SUFFIXES = ("ac.at", "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.at", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "gov.au", "gov.in", "gov.uk", "gov.za", "ltd.uk", "me.uk", "net.au", "net.nz", "net.uk", "nhs.uk", "or.at", "or.jp", "org.au", "org.br", "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk")


def folded(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def links(cards: DataFrame) -> DataFrame:
    """(a, b, reason) from each card to the first of its bucket, rather than between all that share a key.

    cards: id, name, company, email, phone, mobile. A shared address or number counts between cards of
    one name only; a name alone needs two words.
    """
    name = folded(F.regexp_replace("name", "#", " "))
    keys = {
        "same email": F.concat_ws("\u0001", name, F.nullif(folded(F.col("email")), F.lit(""))),
        "same phone": F.concat_ws("\u0001", name, F.when(F.col("mobile"), T.phone_key(F.col("phone")))),
        "same landline and name": F.concat_ws("\u0001", name, F.when(~F.col("mobile"), T.phone_key(F.col("phone")))),
        "same name and company": F.concat_ws("\u0001", name, F.nullif(folded(F.col("company")), F.lit(""))),
        "same name": F.when(F.size(F.split(name, " ")) >= 2, F.concat(name, F.lit("\u0001"))),
    }
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.when(k.contains("\u0001"), k).alias("k")) for r, k in keys.items()])
    rows = cards.select("id", F.explode(pairs).alias("p")).select("id", "p.reason", "p.k").filter("k is not null")
    first = rows.groupBy("reason", "k").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, ["reason", "k"]).filter("id != b").select(F.col("id").alias("a"), "b", "reason")


def duplicates(cards: DataFrame) -> DataFrame:
    """(id, component, confidence, safe, reasons): groups of cards that look like one person's.

    Safe reasons join first; groups that only weaker reasons join are suggestions.
    """
    return grouped(links(cards))


def grouped(found: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """duplicates() of links (a, b, reason). A group that safe reasons join but that holds a rejected pair (a, b) isn't safe."""
    found = kept(found, "links")
    sure = graphs.components(found.filter(F.col("reason").isin(*SAFE)).select("a", "b"))
    rated = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    place = lambda df, c: df.join(sure.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group")), c, "left").withColumn(f"{c}_group", F.coalesce(f"{c}_group", c))
    met = place(place(found, "a"), "b")
    strong = F.col("reason").isin(*SAFE)
    weak = met.filter(~strong & (F.col("a_group") != F.col("b_group")))
    joined = graphs.components(weak.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")))
    best = lambda df, key: df.groupBy(key.alias("component")).agg(F.max(F.element_at(rated, F.col("reason"))).alias("confidence"), F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reasons"))
    certain = sure.select(F.col("node").alias("id"), "component").join(best(met.filter(strong), F.col("a_group")), "component").withColumn("safe", F.lit(True))
    if rejected is not None:
        inside = place(place(rejected.select("a", "b"), "a"), "b").filter("a_group = b_group").select(F.col("a_group").alias("component"), F.lit(True).alias("doubt")).distinct()
        certain = certain.join(inside, "component", "left").withColumn("safe", F.col("doubt").isNull()).drop("doubt")
    top = lambda df: df.join(joined.select(F.col("node").alias("a_group"), F.col("component").alias("top")), "a_group")
    loose = best(top(weak), F.col("top")).withColumn("safe", F.lit(False))
    groups = joined.select(F.col("node").alias("g"), "component")
    members = groups.join(sure.select(F.col("node").alias("id"), F.col("component").alias("g")), "g", "left").select(F.coalesce("id", "g").alias("id"), "component")
    columns = ["id", "component", "confidence", "safe", "reasons"]
    return certain.select(*columns).unionByName(members.join(loose, "component").select(*columns))


def merged(cards: DataFrame, group: str) -> DataFrame:
    """One card a group: the first name and company that aren't empty, all addresses and numbers once, notes
    joined, favourite if one is, and whether companies differ."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("id"))).alias(c)
    each = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s")
    return cards.groupBy(group).agg(
        F.min("id").alias("id"), first("name"), first("company"), each("email"), each("phone"), F.count("*").alias("n"),
        F.max("favourite").alias("favourite"), (F.count_distinct("company") > 1).alias("conflict"),
    )


def reverted(journal: DataFrame, batch: int) -> DataFrame:
    """(id, value): each card's value after a batch and all later changes to its cards are taken back.

    journal: id, seq, batch, before, after. A card that the batch didn't touch keeps its last value.
    """
    touched = F.min(F.when(F.col("batch") == batch, F.col("seq")))
    old = F.min_by("before", F.when(F.col("batch") == batch, F.col("seq")))
    return journal.groupBy("id").agg(F.when(touched.isNotNull(), old).otherwise(F.max_by("after", "seq")).alias("value"))


def company_guess(email: Column) -> Column:
    """The company that an address's host names: the label before its public suffix, its hyphens as spaces and
    its words capitalised. Null for hosts of free mail, without a dot or with signs that hosts don't have."""
    host = F.regexp_extract(F.lower(F.trim(email)), "^[^@]+@([a-z0-9.-]+)$", 1)
    tail = lambda n: F.array_join(F.slice(F.reverse(F.split(host, "[.]")), 1, n), ".")  # noqa: E731  last labels, last first
    turned = F.lit([".".join(reversed(s.split("."))) for s in SUFFIXES])
    own = F.when(F.array_contains(turned, tail(2)), F.lit(3)).otherwise(F.lit(2))
    label = F.get(F.reverse(F.split(host, "[.]")), own - 1)
    free = host.isin(*FREE_MAIL) | F.exists(F.lit(list(FREE_MAIL)), lambda h: F.endswith(host, F.concat(F.lit("."), h)))
    known = host.contains(".") & ~host.contains("..") & ~free & (label != "")
    return F.when(known, F.initcap(F.translate(label, "-", " ")))


def named_in(cards: DataFrame, query: str) -> DataFrame:
    """Cards whose whole name a query holds."""
    return cards.filter((F.length("name") >= 3) & F.lit(query.lower()).contains(F.lower("name")))
