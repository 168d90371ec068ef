"""Answers held against their sources: support of sentences, coverage of searches, words of one's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T

LEAST_WORDS, LEAST_SUPPORT, LEAST_COVERAGE = 2, 0.70, 0.5
#: Where a word begins and ends. The engines' own borders know different letters: noé is no word "no".
BEGINS, ENDS = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
# The words that deny in English, and the ending of their contractions.
NEGATION = rf"(?i){BEGINS}(?:barely|cannot|hardly|lacks?|neither|never|no|nobody|none|nor|not|nothing|nowhere|scarcely|without){ENDS}|n['’]t{ENDS}"


def numbers(c: Column) -> Column:
    """Numbers of a text, without their separators, each once."""
    found = F.regexp_extract_all(c, F.lit(r"[0-9][0-9,]*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def verdicts(claims: DataFrame) -> DataFrame:
    """claims (sentence, evidence, ...) with support and accepted.

    A sentence is accepted if it has LEAST_WORDS words, LEAST_SUPPORT of them are in the evidence, all of its
    numbers are, and it is negated as the evidence is.
    """
    wanted, have = F.array_distinct(T.words(F.col("sentence"))), F.array_distinct(T.words(F.col("evidence")))
    support = F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(1))
    grounded = F.size(F.array_except(numbers(F.col("sentence")), numbers(F.col("evidence")))) == 0
    agrees = F.col("sentence").rlike(NEGATION) == F.col("evidence").rlike(NEGATION)
    return claims.select("*", F.round(support, 6).alias("support"), ((F.size(wanted) >= LEAST_WORDS) & (support >= LEAST_SUPPORT) & grounded & agrees).alias("accepted"))


def reconciled(judged: DataFrame, key: str, order: str) -> DataFrame:
    """(key, answer, dropped): an answer of its accepted sentences, in order."""
    kept = F.filter(F.sort_array(F.collect_list(F.struct(order, "accepted", "sentence"))), lambda x: x["accepted"])
    return judged.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["sentence"]), " ").alias("answer"), F.count_if(~F.col("accepted")).alias("dropped"))


def coverage(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, coverage, thin): the largest share of a query's words that one of its hits has; thin under a half.

    wanted: (qid, words); hits: (qid, words). A query without hits is thin.
    """
    have = hits.select("qid", F.col("words").alias("have"))
    share = F.size(F.array_intersect("words", "have")) / F.greatest(F.size("words"), F.lit(1))
    best = wanted.join(have, "qid", "left").groupBy("qid").agg(F.round(F.coalesce(F.max(share), F.lit(0.0)), 6).alias("coverage"))
    return best.withColumn("thin", F.col("coverage") < LEAST_COVERAGE)


def widened(terms: Sequence[str], filters: bool) -> list[list[str]]:
    """Searches to try after a thin one: without its filters, then its three longest words."""
    out = [list(terms)] if filters and terms else []
    return out + ([sorted(terms, key=len, reverse=True)[:3]] if len(terms) > 3 else [])


def substituted(text: Column, meanings: dict[str, str]) -> Column:
    """Phrases of one's own replaced by what they mean, longest first, whole words without regard to case."""
    for phrase in sorted(meanings, key=len, reverse=True):
        escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)
        text = F.regexp_replace(text, rf"(?i)\b{escaped}\b", meanings[phrase])
    return text


#: Words after which a run without a stop is cut, as a sentence is.
LONGEST = 60
# The months in English.
MONTHS = "january february march april may june july august september october november december".split()
#: Of each month, patterns of its name and of a date in it.
MONTH_FORMS = [(rf"{BEGINS}May{ENDS}" if m == "may" else rf"(?i){BEGINS}(?:{m}|{m[:3]}){ENDS}", rf"{BEGINS}[0-9]{{4}}-{i:02}-[0-9]{{2}}{ENDS}") for i, m in enumerate(MONTHS, 1)]
_STOPPED, _UNSTOPPED = r"([.!?…]['\")\]]*)[ \t\r\n]+|\n[ \t\r]*\n", r"((?:[^ \t\r\n\x01]++[ \t\r\n]++){%d})" % LONGEST
_ENDINGS = "^(.{3,}?)(?:ing|ed|es|ly|s)$"
_NAME, _QUOTED = r"[^\p{L}\p{N}.!?](\p{Lu}\p{L}+)", '"([^"]*[^" ] [^" ][^"]*)"'


def sentences(c: Column) -> Column:
    """The sentences of a text, trimmed and not empty; LONGEST words without a stop end one too. Null has none."""
    marked = F.regexp_replace(F.regexp_replace(c, _STOPPED, "$1\x01"), _UNSTOPPED, "$1\x01")
    return F.coalesce(F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.btrim(s, F.lit(" \t\r\n"))), lambda s: s != ""), F.array().cast("array<string>"))


def light_stems(c: Column) -> Column:
    """The distinct words of a text without their commonest endings."""
    return F.array_distinct(F.transform(T.words(c), lambda w: F.regexp_replace(w, _ENDINGS, "$1")))


def plain_quotes(c: Column) -> Column:
    """One kind of quotation mark and single spaces."""
    return F.regexp_replace(F.regexp_replace(c, "[“”„«»]", '"'), "[ \t\r\n]+", " ")


def months(c: Column, dates: bool) -> Column:
    """Numbers of the months that a text names, and with `dates` those of its dates as 2024-05-31. May is one as May only."""
    found = [F.when(c.rlike(n) | (c.rlike(d) if dates else F.lit(False)), i) for i, (n, d) in enumerate(MONTH_FORMS, 1)]
    return F.array_compact(F.array(*found))


def prepared(rows: DataFrame) -> DataFrame:
    """rows with what aligned needs of their evidence in its place; where many claims have one evidence, it is cut once before they meet."""
    cut = rows.withColumn("_pieces", sentences(F.col("evidence"))).drop("evidence")
    return cut.withColumn("_stems", F.transform("_pieces", light_stems))


def aligned(claims: DataFrame) -> DataFrame:
    """claims (sentence, evidence, ...) with support, receipt, accepted and reason. The evidence may be prepared.

    The receipt is the sentence of the evidence, or two that follow each other, with the largest share of the claim's
    stems; of equals the shortest, then the first. A claim is accepted if it has LEAST_WORDS stems, the receipt
    LEAST_SUPPORT of them, if both deny or neither does, and if the claim's numbers, months, names (capitalised words
    inside it) and quotations of two words and more are all in the receipt; months are no names. Words that the evidence holds far apart
    support nothing together. reason names the first test that failed. A row's work grows with its evidence.
    """
    wanted, text = light_stems(F.col("sentence")), F.coalesce("sentence", F.lit(""))
    given = claims if "_stems" in claims.columns else prepared(claims.withColumn("_evidence", F.col("evidence"))).withColumnRenamed("_evidence", "evidence")
    rows = given.withColumn("_w", F.coalesce(wanted, F.array().cast("array<string>"))).withColumnRenamed("_pieces", "_p")
    rows = rows.withColumn("_q", F.transform("_stems", lambda s: F.array_intersect(s, F.col("_w"))))

    def score(i: Column, n: int) -> Column:
        last, here = i + n - 1, F.get("_q", i)
        have = here if n == 1 else F.array_union(here, F.get("_q", last))
        size = F.length(F.get("_p", i)) + (F.lit(0) if n == 1 else 1 + F.length(F.get("_p", last)))
        return F.struct(F.size(have).alias("have"), (-size).alias("size"), (-i).alias("i"), F.lit(-n).alias("n"))

    def best(_: Column, i: Column) -> Column:
        return F.when(i + 1 < F.size("_p"), F.greatest(score(i, 1), score(i, 2))).otherwise(score(i, 1))

    rows = rows.withColumn("_b", F.array_max(F.transform("_q", best)))
    rows = rows.withColumn("receipt", F.coalesce(F.array_join(F.slice("_p", F.coalesce(1 - F.col("_b.i"), F.lit(1)), F.coalesce(-F.col("_b.n"), F.lit(1))), " "), F.lit("")))
    support = F.coalesce(F.col("_b.have"), F.lit(0)) / F.greatest(F.size("_w"), F.lit(1))
    receipt = F.col("receipt")
    lacks = lambda of, have: F.size(F.array_except(of, have)) > 0
    names = F.array_except(F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(1)), F.lower), F.lit(MONTHS))
    quotes = F.regexp_extract_all(plain_quotes(text), F.lit(_QUOTED), F.lit(1))
    reason = (
        F.when(F.size("_w") < LEAST_WORDS, "too little").when(support < LEAST_SUPPORT, "unsupported").when(text.rlike(NEGATION) != receipt.rlike(NEGATION), "negation")
        .when(lacks(numbers(text), numbers(receipt)), "number").when(lacks(months(text, False), months(receipt, True)), "month")
        .when(lacks(names, T.words(receipt)), "name").when(F.exists(quotes, lambda x: ~F.contains(plain_quotes(receipt), x)), "quotation")
    )
    out = rows.withColumn("support", F.round(support, 6)).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return out.drop("_w", "_p", "_q", "_b", "_stems")
