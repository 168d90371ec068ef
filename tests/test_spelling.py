"""Spelling against distances over a whole vocabulary, and typed words as runs of words."""

import random

from pyspark.sql import functions as F

from brindle.operators import spelling
from brindle.plans import grammar
from brindle.plans.search import corrected, forms, matching
from brindle.sources.corpus import Corpus

DATA = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def of_texts(spark, tmp_path, texts):
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    return Corpus(spark, f"file://{tmp_path}")


def test_nearest_words_in_any_script(spark, tmp_path):
    r = random.Random(1)
    alphabets = ["abc", "äöüß", "αβγδ", "жзи", "漢字語"]
    terms = sorted({"".join(r.choice(a) for _ in range(r.randint(3, 11))) for a in alphabets for _ in range(150)})
    corpus = of_texts(spark, tmp_path, [" ".join(terms), " ".join(terms[::3]), " ".join(terms[::5])])
    df = {t: 1 + (i % 3 == 0) + (i % 5 == 0) for i, t in enumerate(terms)}
    asked = set(terms[::7])
    for t in terms[::4]:
        w = list(t)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = r.choice("aäαж字q")
        asked.add("".join(w) + r.choice(["", "x"]))
    got = {x["word"]: (x["suggestion"], x["distance"]) for x in spelling.suggestions(corpus, spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
    for w in asked:
        near = sorted((edits(w, t), -df[t], t) for t in terms if t != w and edits(w, t) <= (2 if len(w) >= 7 else 1)) if len(w) >= 4 else []
        assert got.get(w) == ((near[0][2], near[0][0]) if near else None), w


def test_parts_of_a_typed_word_follow_each_other(spark, tmp_path):
    texts = ["it cost 2,373 then", "only 2 here and 373 there", "2373 plain", "a co-op shop", "co and then op", "call parse_http_request now", "parseHttpRequest", "http parse request", "license text"]
    corpus = of_texts(spark, tmp_path, texts)
    found = lambda t: {x["doc_id"] for x in matching(corpus, grammar.parse(t)).collect()}
    assert found("2,373") == {0, 2} and found("2373") == {0, 2}
    assert found("co-op") == {3}
    assert found("parseHttpRequest") == {5, 6} and found("parse_http_request") == {5, 6}
    assert forms(corpus, "plain*") == [("plain",)]


def test_one_unknown_word_is_corrected(spark, tmp_path):
    corpus = of_texts(spark, tmp_path, ["license text of the version", "license"])
    words = lambda t: corrected(corpus, grammar.parse(t)).terms
    assert words("licemse version") == ("license", "version")
    assert words("licemse versoin") == ("licemse", "versoin")  # two are unknown
    assert words("license version") == ("license", "version") and words("qqqqqqq version") == ("qqqqqqq", "version")
