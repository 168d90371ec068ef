"""Postings are stored as one row for a word's documents of a piece of texts, cut from the texts as Spark's expressions cut them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.sources import corpus
from brindle.sources.corpus import WORD_BREAK, Corpus, blocks_of_words, letters

SIGNS = "aAbZ09 _-.,\n\t'éÉßİıΣσςñ中文字٣½²Ⅷ😀𝒜𐐀̀‍힣￿͸\U0001f1e6ſK"


def _texts(n):
    r = random.Random(4)
    return [(i, None if i % 17 == 0 else "".join(r.choice(SIGNS) for _ in range(r.randrange(60)))) for i in range(n)]


def _saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return Corpus(spark, str(tmp_path))


def test_opened_blocks_are_the_postings(spark, tmp_path):
    c = _saved(spark, tmp_path, [*_texts(1500), (5000, "same same same"), (5001, " "), (5002, "same")])
    words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
    placed = c.table("documents").select("doc_id", F.posexplode(words).alias("p", "term"), F.size(words).cast("long").alias("len"))
    expected = placed.groupBy("term", "doc_id", "len").agg(F.sort_array(F.collect_list("p")).alias("pos"))
    key = lambda r: (r["term"], r["doc_id"], tuple(r["pos"]), r["len"])
    got = c.postings.collect()
    assert sorted(map(key, got)) == sorted(map(key, expected.collect())) and len(got) > 5000
    assert all(r["tf"] == len(r["pos"]) for r in got)
    assert {(r["term"], r["df"]) for r in c.vocabulary.collect()} == {(r["term"], r["n"]) for r in expected.groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_rows_of_words_are_shuffled_not_words_of_documents(spark, tmp_path):
    rows = [(i, f"the and common word{i % 3}") for i in range(400)]
    c = _saved(spark, tmp_path, rows)
    assert c.postings.count() == 1600
    assert c.blocks.count() <= 6 * c.table("documents").rdd.getNumPartitions()


def test_pieces_of_any_size_and_slices(spark, monkeypatch):
    bits = letters(spark)
    monkeypatch.setattr(corpus.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 7})())
    rows = [(i, t.lower()) for i, t in _texts(200) if t is not None]
    of_words = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    expected = set()
    for i, t in rows:
        words = "".join(x if of_words[ord(x)] else " " for x in t).split()
        expected |= {(w, i, tuple(p for p, v in enumerate(words) if v == w), len(words)) for w in words}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    for most in (1, 300, 10**6):
        monkeypatch.setattr(corpus, "BYTES_AT_ONCE", most)
        for part in (batch, batch.slice(11, 60), batch.slice(5, 0)):
            found = [r for b in blocks_of_words(bits)([part]) for r in b.to_pylist()]
            got = set()
            for r in found:
                begin = 0
                for d, n, end in zip(r["docs"], r["lens"], r["ends"], strict=True):
                    got.add((r["term"], d, tuple(r["pos"][begin:end]), n))
                    begin = end
                assert begin == len(r["pos"])
            ids = set(part.column(0).to_pylist())
            assert got == {x for x in expected if x[1] in ids}
            if part is batch:
                assert len({r["piece"] for r in found}) == 1 if most > 1000 else len({r["piece"] for r in found}) > 10
