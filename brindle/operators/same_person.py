"""Cards that may be one person's: shared addresses and numbers between names that agree, and shared names.

Links are stars, never all pairs of those that share a key. Two names agree if in each of their parts (family, given)
a word of one begins a word of the other, or one has none; so all cards of a key meet in hubs, one a pair of
beginnings, where a card is strong in a part if the beginning is its whole word (or it has no word) and weak
otherwise. Two cards of a hub agree if in each part one of them is strong. A card has some eighty hubs a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators.contacts import folded, grouped
from brindle.sources.store import kept


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(folded(F.coalesce(c, F.lit(""))), "-.", "  "), " "), lambda w: w != ""))


def _full(*parts: str) -> Column:
    return folded(F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts]))


def _beginnings(words: Column) -> Column:
    """Structs (w, strong): words, their beginnings, and the empty word, which is strong where there are no words."""
    heads = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda n: F.substring(w, F.lit(1), n))
    short = F.array_except(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 1), heads)), words)
    unit = lambda strong: lambda w: F.struct(w.alias("w"), F.lit(strong).alias("strong"))
    return F.concat(F.transform(words, unit(True)), F.transform(F.array_distinct(short), unit(False)), F.array(F.struct(F.lit("").alias("w"), (F.size(words) == 0).alias("strong"))))


def _keys(cards: DataFrame, shared: DataFrame | None) -> DataFrame:
    """(id, reason, key) of addresses and numbers that two cards hold and nobody called shared."""
    digits = lambda p: F.regexp_replace(p["value"], "[^0-9]+", "")
    unit = lambda r, k, v: F.struct(r.alias("reason"), k.alias("key"), v.alias("value"))
    mails = F.transform(F.coalesce("emails", F.array()), lambda e: unit(F.lit("same email"), folded(e), F.concat(F.lit("email:"), folded(e))))
    e164 = lambda p: T.phone_key(p["value"])
    phones = F.transform("phones", lambda p: F.when(
        e164(p).startswith("+"), unit(F.when(p["mobile"], "same phone").otherwise("same landline and name"), e164(p), F.concat(F.lit("phone:"), e164(p))),
    ).when(F.length(digits(p)) >= 7, unit(F.lit("same phone digits"), F.right(digits(p), F.lit(9)), F.lit(""))))
    every = F.concat(mails, F.coalesce(phones, F.array()))
    rows = cards.select("id", F.explode(every).alias("u")).filter("u.key != ''").select("id", "u.*").distinct()
    if shared is not None:
        rows = rows.join(shared.select("value").distinct(), "value", "left_anti")
    held = rows.groupBy("reason", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.drop("value").join(held, ["reason", "key"])


def _hubs(cards: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, reason, hub, family, given) of cards at their keys; family and given tell whether they are strong."""
    named = cards.select("id", _words(F.col("family")).alias("f"), _words(F.col("given")).alias("g"), F.sort_array(_words(F.col("company"))).alias("c"))
    at = keys.join(named, "id")
    hub = lambda *parts: F.concat_ws("\u0001", "reason", "key", *parts)
    person = (F.size("f") > 0) | (F.size("g") > 0) | (F.size("c") == 0)
    people = at.filter(person).withColumn("x", F.explode(_beginnings(F.col("f")))).withColumn("y", F.explode(_beginnings(F.col("g"))))
    people = people.select("id", "reason", hub("x.w", "y.w").alias("hub"), F.col("x.strong").alias("family"), F.col("y.strong").alias("given"))
    # A company agrees with those whose words hold its own or are held by them, and with cards that have no name.
    firms = at.filter(~person)
    weak = firms.select("id", "reason", hub(F.lit(""), F.lit("")).alias("hub"), F.lit(False).alias("family"), F.lit(False).alias("given"))
    kinds = firms.select("reason", "key", "c").distinct()
    wide = kinds.select("reason", "key", F.explode("c").alias("w"), "c")
    narrow = kinds.select("reason", "key", F.get("c", F.lit(0)).alias("w"), F.col("c").alias("whole"))
    met = wide.join(narrow, ["reason", "key", "w"]).filter(F.size(F.array_except("whole", "c")) == 0).select("reason", "key", "c", "whole")
    own = firms.join(met, ["reason", "key", "c"]).select(
        "id", "reason", hub(F.lit("\u0002"), F.array_join("whole", " ")).alias("hub"), (F.col("c") == F.col("whole")).alias("family"), F.lit(True).alias("given")
    )
    return people.unionByName(weak).unionByName(own)


def _names(cards: DataFrame) -> DataFrame:
    """(id, reason, hub, family, given) of whole names, with and without the middle one, and with the company."""
    short, whole, firm = _full("given", "family"), _full("given", "additional", "family"), folded(F.coalesce("company", F.lit("")))
    unit = lambda r, k: F.struct(F.lit(r).alias("reason"), k.alias("key"))
    both = F.filter(F.array_distinct(F.array(short, whole)), lambda n: F.contains(n, F.lit(" ")))
    units = F.concat(F.transform(both, lambda n: unit("same name", n)), F.when(firm != "", F.array(unit("same name and company", F.concat_ws("|", short, firm)))).otherwise(F.array()))
    rows = cards.select("id", "bare", F.explode(units).alias("u")).select("id", "bare", "u.*")
    copies = rows.filter("reason = 'same name'").groupBy("key").agg(F.count("*").alias("n"), F.count_if("bare").alias("k")).filter("n = 2 and k = 1")
    alone = rows.filter("reason = 'same name'").join(copies, "key").select("id", F.lit("same name, one holds nothing else").alias("reason"), "key")
    return rows.drop("bare").unionByName(alone).select("id", "reason", F.concat_ws("\u0001", "reason", "key").alias("hub"), F.lit(True).alias("family"), F.lit(True).alias("given"))


def links(cards: DataFrame, rejected: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """(a, b, reason): links that reach what all pairs would reach, a rejected pair (a, b) never among them.

    cards: id, given, additional, family, company, emails (array), phones (array of value, mobile), bare (whether
    a card holds nothing but its name). shared: values (email:... or phone:+...) that belong to no one person.
    Each role of a hub has one centre, a card in no rejected pair; where it has none, all of its cards are centres,
    which people's own rejections bound.
    """
    rows = _hubs(cards, _keys(cards, shared)).unionByName(_names(cards)).distinct()
    role = ["hub", "family", "given"]
    if rejected is None:
        rows = rows.withColumn("touched", F.lit(False))
    else:
        both = rejected.select("a", "b").union(rejected.select("b", "a")).distinct()
        rows = rows.join(both.select(F.col("a").alias("id"), F.lit(True).alias("touched")).distinct(), "id", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    busy = rows.groupBy("hub").agg((F.min("id") < F.max("id")).alias("busy")).filter("busy").select("hub")
    rows = kept(rows.join(busy, "hub"), "hubs")
    first = rows.filter("not touched").groupBy(*role).agg(F.min("id").alias("a"))
    rest = rows.filter("touched").join(first, role, "left_anti").select(*role, F.col("id").alias("a"))
    centres = first.unionByName(rest).select("hub", "a", F.col("family").alias("af"), F.col("given").alias("ag"))
    found = rows.join(centres, "hub").filter("a != id and (af or family) and (ag or given)")
    pairs = found.select(F.greatest("a", "id").alias("a"), F.least("a", "id").alias("b"), "reason").distinct()
    return pairs if rejected is None else pairs.join(both, ["a", "b"], "left_anti")


def duplicates(cards: DataFrame, rejected: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """(id, component, confidence, safe, reasons): contacts.duplicates of cards with parts of names, several addresses
    and numbers, pairs that somebody called different people, and values that several people share."""
    return grouped(links(cards, rejected, shared), rejected)


def merged(units: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """(grp, field, key, value, label, main, ids, conflict): the card that each group's cards make together.

    units: grp, id, place (of a card in its group), field, many (whether a card can hold several), key (what values are
    compared by), value, label, main. Of a field with one value the first card's counts, unless choices (grp, field, id)
    name a card that has one; differing notes are all kept, between empty lines. Of a field with many, equal keys are one
    value, with the first label that isn't empty, main if one is. ids are the cards that hold what was taken; conflict
    tells fields of one value whose cards differ. Empty values are no values.
    """
    rows = units.withColumn("value", F.trim("value")).filter("value != ''").withColumn("key", F.when(F.col("many"), F.coalesce("key", "value")))
    if choices is None:
        rows = rows.withColumn("choice", F.lit(None).cast("long"))
    else:
        rows = rows.join(choices.select("grp", "field", F.col("id").alias("choice")), ["grp", "field"], "left")
    held = F.sort_array(F.collect_list(F.struct("place", "id", "value")))
    label = F.min_by("label", F.when(F.coalesce("label", F.lit("")) != "", F.col("place")))
    chosen = F.max(F.when(F.col("id") == F.col("choice"), F.col("value")))
    each = rows.groupBy("grp", "field", "many", "key").agg(
        held.alias("held"), label.alias("label"), F.max("main").alias("main"), chosen.alias("chosen"), (F.count_distinct("value") > 1).alias("differ"),
    )
    texts = F.array_distinct(F.transform("held", lambda h: h["value"]))
    notes = (F.col("field") == "notes") & F.col("differ") & F.col("chosen").isNull()
    value = F.when(~F.col("many") & F.col("chosen").isNotNull(), F.col("chosen")).when(notes, F.array_join(texts, "\n\n")).otherwise(texts[0])
    same = F.filter("held", lambda h: F.col("many") | notes | (h["value"] == F.col("value")))
    out = each.withColumn("value", value).withColumn("ids", F.transform(same, lambda h: h["id"]))
    return out.select("grp", "field", "key", "value", "label", "main", "ids", (~F.col("many") & F.col("differ")).alias("conflict"))


def undone(now: DataFrame, journal: DataFrame, batch: int) -> DataFrame:
    """(id, field, value, taken_back): the values of now (id, field, value) after one batch of the journal is taken back.

    journal: batch, seq, id, field, before, after (null: the field wasn't there, or went). A field goes back to what it
    was before the batch if it still is as the batch left it; what was changed since stays, with taken_back false.
    Fields that the batch didn't touch have a null taken_back.
    """
    own = journal.filter(F.col("batch") == batch).groupBy("id", "field").agg(F.min_by("before", "seq").alias("b"), F.max_by("after", "seq").alias("a"), F.lit(True).alias("touched"))
    both = now.join(own, ["id", "field"], "full")
    back = F.col("value").eqNullSafe(F.col("a"))
    out = both.select("id", "field", F.when(F.col("touched") & back, F.col("b")).otherwise(F.col("value")).alias("value"), F.when(F.col("touched"), back).alias("taken_back"))
    return out.filter("value is not null")
