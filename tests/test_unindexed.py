"""A search for few words needs no index: while none is stored, the texts give what the postings give."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import keyword
from brindle.plans.search import forms
from brindle.queries.all import QUERIES
from brindle.sources.corpus import Corpus

WORDS = ["licence", "License", "LICENSED", "licen", "unlicensed", "lic", "lice", "5556869", "6869", "x6869", "2373", "the", "été", "İlicense", "liÇe", "Klice", "thing", "Thwarting", "und", "Under", "andAnOr", "and", "an", "or"]


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(5)
    texts = [(i, None if i % 19 == 0 else "" if i % 23 == 0 else r.choice("  \n-_")[0].join(r.choice(WORDS) for _ in range(r.randrange(1, 40)))) for i in range(500)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["number_variants", "bm25_prefix", "search_wildcard", "wildcard_expand", "search_interim", "bm25_not", "identifier_terms"])
def test_rows_are_those_of_the_index_and_none_is_written(spark, folder, name):
    found = QUERIES[name](spark, folder)
    first = rows(found)
    c = Corpus(spark, folder)
    assert first and not c.indexed
    c.postings.schema  # noqa: B018  written now
    assert Corpus(spark, folder).indexed and rows(QUERIES[name](spark, folder)) == first


def test_words_of_texts_are_counted_as_in_the_postings(spark, folder):
    c = Corpus(spark, folder)
    asked = {
        "isin": (lambda w: w.isin("licence", "the", "x6869"), ["licence", "the", "x6869"]), "all": (lambda w: F.length(w) > 0, []),
        "none": (lambda w: w.isin([]), []), "piece": (lambda w: w.endswith("lice"), ["lice"]),
    }
    plain = {k: rows(keyword.counts_where(c, *how)) for k, how in asked.items()}
    words = [rows(keyword.counts_of_words(c, ws)) for ws in (["the", "été"], WORDS, [])]
    assert not c.indexed
    c.postings.schema  # noqa: B018  written now
    assert c.indexed
    assert {k: rows(keyword.counts_where(c, *how)) for k, how in asked.items()} == plain and plain["all"] and not plain["none"]
    assert [rows(keyword.counts_of_words(c, ws)) for ws in (["the", "été"], WORDS, [])] == words


def test_patterns_stand_for_the_same_words_without_a_vocabulary(spark, folder):
    c = Corpus(spark, folder)
    patterns = ["lic*", "*lic*e", "l?ce", "*É*", "x?8*9", "li*zz*", "L*-e", "?i"]
    plain = [forms(c, p) for p in patterns]
    assert not c.listed and plain[0] and plain[1] and plain[2] and plain[4] == [("x6869",)]
    assert rows(c.vocabulary) and c.listed
    assert [forms(Corpus(spark, folder), p) for p in patterns] == plain
    assert [T.glob_piece(p) for p in ("lic*e", "?a*bcd*", "*_*", "a-bc")] == ["lic", "bcd", "", "bc"]
