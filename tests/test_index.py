"""The index is written by tasks of bounded size, and a document's words meet the queries in one task."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.operators import keyword
from brindle.sources import corpus
from brindle.sources.corpus import Corpus, runs_of_words


def _texts(n):
    r = random.Random(3)
    words = ["the", "été", "ab", "abc", "x9", "ñu", "z"] + [f"w{i}" for i in range(40)]
    return [(i, None if i % 29 == 0 else "" if i % 31 == 0 else "--" + " ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + "!") for i in range(n)]


def _expected(rows):
    out = {}
    for i, text in rows:
        words = [w for w in re.split(r"\W+", text or "") if w]
        for p, w in enumerate(words):
            out.setdefault((w, i), ([], len(words)))[0].append(p)
    return {(w, i, tuple(ps), n) for (w, i), (ps, n) in out.items()}


def test_runs_of_words_in_pieces(monkeypatch):
    rows = [(i, [w for w in re.split(r"\W+", t or "") if w]) for i, t in _texts(60)]
    rows = [r for r in rows if r[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.string()))], ["doc_id", "w"])
    for at_once in (1, 100, 10**6):
        monkeypatch.setattr(corpus, "AT_ONCE", at_once)
        for part in (batch, batch.slice(7, 20)):
            found = list(runs_of_words([part]))
            assert len(found) == 1 if at_once > 1000 else len(found) > 1
            got = [(r["term"], r["doc_id"], tuple(r["pos"]), r["len"]) for b in found for r in b.to_pylist()]
            ids = set(part.column(0).to_pylist())
            assert sorted(got) == sorted(x for x in _expected(_texts(60)) if x[1] in ids)
            assert all(b.column("term").to_pylist() == sorted(b.column("term").to_pylist(), key=lambda w: w.encode()) for b in found)


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame(_texts(400), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus, "BUCKET_BYTES", 1_000)
    c = Corpus(spark, str(tmp_path))
    got = {(r["term"], r["doc_id"], tuple(r["pos"]), r["len"]) for r in c.postings.collect()}
    assert got == _expected(_texts(400))
    the = c.postings.filter("term = 'the'").select("b", F.input_file_name().alias("f")).distinct().collect()
    assert len({r["b"] for r in the}) == 1 and len(the) == corpus.MOST_PARTS


def test_scores_shuffle_a_document_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame(_texts(300), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = Corpus(spark, str(tmp_path))
    asked = spark.createDataFrame([(q, w) for q in range(20) for w in ("the", "été", f"w{q}", "nowhere")] + [(99, "nowhere")], "qid long, term string")
    monkeypatch.setattr(keyword, "MET_AT_ONCE", 50)
    found = keyword.scores(c, asked)
    assert found.rdd.getNumPartitions() > 50
    part = {(r["term"], r["doc_id"]): r["part"] for r in keyword.parts(c, asked).collect()}
    expected = {}
    for r in asked.collect():
        for (w, d), p in part.items():
            if w == r["term"]:
                s, n = expected.get((r["qid"], d), (0.0, 0))
                expected[(r["qid"], d)] = (s + p, n + 1)
    got = {(r["qid"], r["doc_id"]): (r["score"], r["matched"]) for r in found.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k][0] - v[0]) < 1e-9 and got[k][1] == v[1] for k, v in expected.items())
    assert keyword.scores(c, asked.filter("qid = 99")).count() == 0
