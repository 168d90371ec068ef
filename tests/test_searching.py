"""What the search's parts do where no SQL says it."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import answers, code, filters, ranking, tidy
from brindle.plans.grammar import parse
from brindle.sources.corpus import Corpus

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, DATA)


def test_no_filter_is_left_out(corpus):
    for text in ("saved:x only:nothing", "only:nothing"):
        with pytest.raises(ValueError):
            filters.apply(corpus.files, parse(text), corpus)
    q = parse("type:pdf")
    with pytest.raises(ValueError):
        filters.apply(corpus.files, type(q)(filters={"colour": ["red"]}), corpus)
    assert filters.apply(corpus.listing, parse("from:nobody"), corpus).count() == 0


def test_an_index_is_built_once_and_anew_for_new_input(spark, tmp_path):
    spark.createDataFrame([(1, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    c = Corpus(spark, f"file://{tmp_path}")
    first = c.store.folder
    assert {r["term"] for r in c.vocabulary.collect()} == {"one", "two"} and Corpus(spark, f"file://{tmp_path}").store.folder == first
    spark.createDataFrame([(2, "three", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"file://{tmp_path}/documents.parquet")
    again = Corpus(spark, f"file://{tmp_path}")
    assert again.store.folder != first and {r["term"] for r in again.vocabulary.collect()} == {"one", "two", "three"}


def test_greedy_clusters(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        rows.append((i, r.getrandbits(63) if i % 3 == 0 or not rows else rows[r.randrange(len(rows))][1] ^ sum(1 << r.randrange(63) for _ in range(r.randint(0, 12)))))
    df = spark.createDataFrame(rows, "id long, h long")
    pairs = tidy.near_hashes(df.select(F.lit(1).alias("grp"), "id", "h"))
    expected = sorted((a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 16)
    assert sorted(tuple(p) for p in pairs.collect()) == expected
    reps, want = [], {}
    for i, h in rows:
        near = [j for j, x in reps if (x ^ h).bit_count() <= 16]
        want[i] = near[0] if near else i
        if not near:
            reps.append((i, h))
    assert {x["id"]: x["cluster"] for x in tidy.greedy_clusters(df, pairs).collect()} == want


def test_folding_of_copies_and_versions(spark):
    rows = [(1, 1, "/a/plan.txt", 5, "h1"), (2, 2, "/a/plan v2.txt", 9, "h2"), (3, 3, "/b/plan.txt", 1, "h3"), (4, 4, "/c/x.txt", 2, "h1"), (5, 5, "/a/semifinal.txt", 3, None), (6, 6, "/a/plan (1).txt", 9, "h6")]
    hits = spark.createDataFrame(rows, "rank int, id long, path string, mtime_ns long, content_hash string")
    got = {r["id"]: (r["rank"], r["folded"]) for r in ranking.fold(hits).collect()}
    assert got == {2: (1, [1, 4, 6]), 3: (3, []), 5: (5, [])}


def test_history_questions():
    import datetime as dt

    q = code.parse_history('author:ann since:1997 until:1998-02 path:a.py added:"x y" fix it', dt.date(2024, 1, 1))
    assert (q.author, q.since, q.until, q.path, q.added, q.message) == ("ann", dt.date(1997, 1, 1), dt.date(1998, 2, 28), "a.py", "x y", "fix it")
    assert code.needles(["Handlers", "at", "parse", "happy", "parsing"]) == ["handler", "at", "pars", "happ"]


def test_wider_searches():
    assert answers.widened(["a", "bb", "ccc", "dddd"], True) == [["a", "bb", "ccc", "dddd"], ["dddd", "ccc", "bb"]]
    assert answers.widened(["a"], False) == []
