"""Queries over more rows than a page or a broadcast block holds."""

import random

from pyspark.sql import functions as F

from brindle.operators import ranking, vectors
from brindle.queries import retrieval


class Tables:
    def __init__(self, files=None, **tables):
        self.files, self.tables = files, tables

    def table(self, name):
        return self.tables[name]


def test_fold_copies_over_all_rows(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["pdf", "txt"]), r.choice([None, f"h{r.randrange(300)}"]), r.randrange(50), r.choice([None, r.randrange(40)])) for i in range(3000)]
    files = spark.createDataFrame(rows, "id long, ext string, content_hash string, mtime_ns long, size_bytes long").repartition(5)
    groups = {}
    pdf = sorted((x for x in rows if x[1] == "pdf"), key=lambda x: (x[4] is None, -(x[4] or 0), x[0]))
    for place, (i, _, g, mtime, _) in enumerate(pdf, 1):
        groups.setdefault(g or f"#{i}", []).append((mtime, -i, place))
    assert len(pdf) > 1000
    expected = {(-max(g)[1], min(x[2] for x in g), len(g) - 1) for g in groups.values()}
    got = [tuple(x) for x in retrieval.fold_copies(Tables(files)).select("head", "position", "older").collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert ranking.positions(files.limit(0), F.asc("id")).count() == 0


def test_nearest_of_more_queries_than_a_block(spark):
    r = random.Random(5)
    known = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(2300)]
    df = spark.createDataFrame(known, "id long, v array<double>")
    some = df.filter("id % 23 = 0")
    got = vectors.knn(df.select(F.col("id").alias("qid"), F.col("v").alias("q")), some, 3).collect()
    assert len(got) == 2300 * 3
    best = {}
    for i, q in known:
        sim = lambda v: round(sum(a * b for a, b in zip(q, v)) / (sum(a * a for a in q) * sum(b * b for b in v)) ** 0.5, 6)  # noqa: B023, B905, E731
        best[i] = sorted((-sim(v), j) for j, v in known if j % 23 == 0 and j != i)[:3]
    assert all(abs(-best[x["qid"]][x["rank"] - 1][0] - x["sim"]) < 2e-6 for x in got)


def test_recall_of_more_passages_than_a_block(spark, monkeypatch):
    passages = spark.createDataFrame([(i, f"passage number {i} end") for i in range(2500)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x passage number {i} end y") for i in range(0, 2500, 5)], "doc_id long, text string")
    top = spark.createDataFrame([(i, i) for i in range(0, 2500, 10)], "qid long, doc_id long")
    monkeypatch.setattr(retrieval, "bm25_top", lambda c: top)
    assert retrieval.recall_at_k(Tables(benchmark=passages, documents=docs)).first()["recall"] == 0.5
