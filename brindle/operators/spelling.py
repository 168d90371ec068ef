"""Spelling: the nearest words of the vocabulary by a stored index of what is left after deletions.

Two words within n edits have a string in common that each becomes by at most n deletions, and so do
their first letters. Those strings are stored for the vocabulary and made for the words asked
about, so candidates are found by equality in any script; an exact distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.corpus import Corpus

#: Letters from which a word is corrected, and from which two edits count instead of one.
LEAST, LONG = 4, 7
#: First letters that deletions are made from; more than the edits, so that nothing near is lost.
PREFIX = 8


def _without_one(words: Column) -> Column:
    """Each word of an array without each of its letters."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w != ""), cut)))


def deletions(word: Column, edits: Column) -> Column:
    """The first letters of a word with none, one or (where edits is 2) two of them deleted, each once."""
    none = F.array(F.substr(word, F.lit(1), F.lit(PREFIX)))
    one = _without_one(none)
    two = F.when(edits >= 2, _without_one(one)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(none, one, two))


def stored(corpus: Corpus) -> DataFrame:
    """(k, term, df, b): deletions of the vocabulary. Two edits can only be asked of words of LONG letters, so
    terms that are more than two shorter have one."""
    edits = F.when(F.length("term") >= LONG - 2, 2).otherwise(1)

    def build() -> DataFrame:
        near = corpus.vocabulary.filter(F.length("term") >= LEAST - 1)
        rows = near.select("term", "df", F.explode(deletions(F.col("term"), edits)).alias("k")).withColumn("b", corpus.bucket("k"))
        return rows.repartition("b").sortWithinPartitions("b", "k")

    return corpus.store.table("deletions", build, "b")


def suggestions(corpus: Corpus, words: DataFrame) -> DataFrame:
    """(word, suggestion, distance) of (word): the nearest other word of the vocabulary within one edit, or two for words of
    LONG letters and more; ties go to the commoner word, then to the first. Shorter words than LEAST have none."""
    edits = F.when(F.length("word") >= LONG, 2).otherwise(1)
    asked = words.select("word").distinct().filter(F.length("word") >= LEAST)
    keys = asked.select("word", F.explode(deletions(F.col("word"), edits)).alias("k")).withColumn("b", corpus.bucket("k"))
    met = keys.join(stored(corpus), ["b", "k"]).filter("term != word").select("word", "term", "df").distinct()
    measured = met.withColumn("distance", F.levenshtein("word", "term")).filter(F.col("distance") <= edits)
    best = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("df"), "term"))
    return measured.withColumn("r", best).filter("r = 1").select("word", F.col("term").alias("suggestion"), "distance")
