"""Generations: writes that are seen at once, readers that keep what they opened, compaction, two writers."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from brindle.operators import keyword
from brindle.sources.corpus import Corpus
from brindle.sources.generations import Generations, Manifest
from brindle.sources.live import Changed, LiveIndex

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, DATA)


def found(corpus, searches):
    return sorted((r["qid"], r["doc_id"], r["score"]) for r in keyword.top(keyword.scores(corpus, searches).select("qid", "doc_id", "score"), 10).collect())


def fresh(corpus, documents):
    """What a new index of the documents would answer."""
    new = Changed(corpus, documents)
    new.postings, new.lengths = new.posted(), new.measured()
    new.vocabulary = new.postings.groupBy("term").agg(F.count("*").alias("df"))
    return new


def test_random_changes_equal_a_fresh_index(spark, corpus):
    r = random.Random(4)
    index, docs = LiveIndex(corpus), {x["doc_id"]: x for x in (row.asDict() for row in corpus.table("documents").collect())}
    schema = corpus.table("documents").schema
    for _ in range(3):
        ids = sorted(docs)
        gone = r.sample(ids, 9)
        changed = [docs[i] | {"text": f"quagga {docs[i]['text'] or ''} license"} for i in r.sample(ids, 7) if i not in gone]
        changed += [docs[i] | {"doc_id": 5000 + r.randrange(10**6)} for i in r.sample(ids, 5)]
        index.change(spark.createDataFrame([tuple(x[c] for c in schema.names) for x in changed], schema), spark.createDataFrame([(i,) for i in gone], "id long"))
        for i in gone:
            del docs[i]
        docs |= {x["doc_id"]: x for x in changed}
    now = spark.createDataFrame([tuple(x[c] for c in schema.names) for x in docs.values()], schema)
    asked = corpus.searches.unionByName(spark.createDataFrame([(-1, "quagga")], "qid long, term string"))
    right = found(fresh(corpus, now), asked)
    assert found(index.reader(), asked) == right and any(q == -1 for q, *_ in right)
    before = index.generations.newest()
    index.compact()
    assert found(index.reader(), asked) == right == found(index.reader(before), asked)
    assert {x["id"] for x in index.rows("files").collect()} == set(docs)


def test_a_reader_keeps_its_generation(corpus):
    index = LiveIndex(corpus)
    old = index.reader()
    counts = lambda at: [index.rows(n, at).count() for n in ("files", "passages", "tags", "lengths", "postings", "vectors")]
    before = counts(old.at)
    index.change(gone=index.rows("files").filter("id % 3 = 0").select("id"))
    after = counts(None)
    assert counts(old.at) == before and all(a < b for a, b in zip(after, before, strict=True))
    assert index.rows("vectors").filter("file_id % 3 = 0").isEmpty() and index.rows("postings").filter("doc_id % 3 = 0").isEmpty()


def test_only_touched_buckets_are_rewritten(corpus):
    index = LiveIndex(corpus)
    one = corpus.table("documents").limit(1).withColumn("doc_id", F.lit(10**7).cast("long")).withColumn("text", F.lit("quagga quagga zebra"))
    index.change(one)
    touched = index.generations.touched(index.generations.newest(), "postings")
    assert 1 <= len(touched) <= 2
    base, delta = index.generations.newest().tables["postings"].segments
    m = index.compact()
    first, last = m.tables["postings"].segments
    assert first.path == base.path and not set(first.buckets) & set(touched) and last.buckets == tuple(touched)
    assert not index.generations.touched(m, "postings")
    got = keyword.postings_of_words(index.reader(), ["quagga"]).collect()
    assert [(x["doc_id"], x["tf"], list(x["pos"]), x["len"]) for x in got] == [(10**7, 2, [0, 1], 3)]


def test_of_two_writers_one_tries_again(spark):
    store = Generations(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark.range(10).write.parquet(f"{store.folder}/base")
    store.create({"t": (f"{store.folder}/base", "id", None, ())})
    seen = []

    def slow(m):
        seen.append(m.gen)
        if len(seen) == 1:  # another writer comes between
            store.write({"t": spark.range(100, 105)}, spark.range(3))
        return Manifest(m.gen + 1, m.tables, m.gone)

    assert store.commit(slow).gen == 3 and seen == [1, 2]
    assert sorted(r["id"] for r in store.rows(store.newest(), "t").collect()) == [*range(3, 10), *range(100, 105)]


def test_vectors_of_another_length_are_refused(spark, corpus):
    index = LiveIndex(corpus)
    n = index.rows("vectors").count()
    batch = [(1, 0, [1.0] * 64), (2, 0, [1.0]), (3, 0, [float("nan")] * 64), (4, 0, [None] * 64)]
    index.append_vectors(spark.createDataFrame(batch, "id long, file_id long, embedding array<float>"))
    assert index.rows("vectors").count() == n + 1
