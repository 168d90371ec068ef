"""The registered queries against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

pytest.importorskip("public_tokenizers")
queries = pytest.importorskip("brindle.llm.queries")
DATA = "/root/testdata/sf0.001"


def tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_warc_with_revisits(spark, tmp_path):
    r = random.Random(2)
    bodies = [None, "", "short", "é" * 600, "long " * 300, "other " * 400]
    rows = [(i, f"http://h{i % 7}.com/{i}", r.choice(bodies)) for i in range(80)]
    got = {x["page_id"]: x for x in queries.op6_warc(spark, tables(spark, tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    largest = {}
    for i, _, body in rows:
        largest[body or ""] = max(i, largest.get(body or "", i))
    assert len(got) == len(rows)
    for i, _, body in rows:
        raw = (body or "").encode()
        again = len(raw) >= 1000 and largest[body or ""] != i
        x = got[i]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (x["record_type"], x["refers_to"]) == (("revisit", largest[body]) if again else ("response", None))


def test_url_rules_on_random_urls(spark, tmp_path):
    r = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.b.www.example.com", "notexample.com", "net", "x.net", "EXAMPLE.COM", "com.net", "", "net."]
    paths = ["", "/", "/en/", "/en", "/es/x", "/fr/?q=/es/", "/EN/", "/en/#/fr/", "?x/en/"]
    urls = [None, "", "example.com/en/", *(r.choice(["http", "https", "a://b"]) + "://" + r.choice(hosts) + r.choice(paths) for _ in range(400))]
    rows = list(enumerate(urls))

    def expected(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
        fit = [(len(h + p), h, p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[1] + best[2], best[3] if best else "allow"

    got = queries.op7_url_filters(spark, tables(spark, tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string"))).collect()
    assert {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in got} == {i: expected(u) for i, u in rows}


def test_mixing_targets(spark, documents):
    sizes = {}
    for _, text, source in documents:
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
    rows = queries.op10_mixing(spark, DATA).collect()
    source_of, taken = {i: s for i, _, s in documents}, dict.fromkeys(order, 0)
    for x in rows:
        s = source_of[x["doc_id"]]
        assert abs(x["target"] - target[s]) < 1e-6 * max(1, target[s]) and x["source_size"] == sizes[s] and 0 <= x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)


def test_digests_of_documents(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    bpe = {x["doc_id"]: x for x in queries.op3_bpe(spark, DATA).collect()}
    pii = {x["doc_id"]: x for x in queries.op2_pii(spark, DATA).collect()}
    quality = {x["doc_id"]: x for x in queries.op4_quality_rules(spark, DATA).collect()}
    for i, text, _ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (bpe[i]["n_tokens"], bpe[i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert bpe[i]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
        base = sorted(brute.base_spans(text), key=lambda x: (("email", "ip", "card", "phone").index(x[0]), x[1]))
        assert pii[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [pii[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        n, chars, symbols, lines, repeats = brute.quality(text)
        q = quality[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert q["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (q["base_failed"] and q["kept"])


def test_links_and_removals_of_documents(spark, documents):
    rows = [(i, t) for i, t, _ in documents]
    near = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op1_near_dedup(spark, DATA).collect()}
    assert near == brute.near_components(rows)
    cut = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in queries.op8_suffix_dedup(spark, DATA).collect()}
    assert cut == brute.suffix(rows)


def test_nearest_over_several_shards(spark, tmp_path):
    r = np.random.default_rng(7)
    x = r.normal(size=(10_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = queries.op5_nearest(spark, tables(spark, tmp_path, embeddings=df)).collect()
    dot, hits = x[::20] @ x.T, 0
    dot[np.arange(500), np.arange(0, 10_000, 20)] = -np.inf
    best = {20 * k: set(np.argsort(-row)[:20].tolist()) for k, row in enumerate(dot)}
    for row in got:
        hits += row["vec_id"] in best[row["query_id"]]
    assert len(got) == 10_000 and hits / 10_000 >= 0.9


def test_very_large_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, [1e200 * (i + 1), 1e190]) for i in range(29)], "vec_id long, embedding array<double>")
    assert queries.op5_nearest(spark, tables(spark, tmp_path, embeddings=df)).count() == 2 * 20


def test_held_out_labels(spark, documents):
    got = queries.op9_toxicity(spark, DATA).collect()
    assert {x["doc_id"]: x["held_out"] for x in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in documents}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)


def test_pipeline_stages(spark, documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(pipeline.STAGES)
    good = stage["quality rules"](spark, docs, DATA)
    judged = {x["doc_id"] for x in queries.op4_quality_rules(spark, DATA).filter("kept").select("doc_id").collect()}
    assert {x["doc_id"] for x in good.select("doc_id").collect()} == judged and good.columns == docs.columns
    left = [x["doc_id"] for x in stage["MinHash near-dedup"](spark, docs, DATA).select("doc_id").collect()]
    assert sorted(left) == sorted(i for i, (_, c) in brute.near_components([d[:2] for d in documents], width=5).items() if c == i)
    messy = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])).withColumn("kept", F.lit(1))
    for name, step in pipeline.STAGES:
        for table in (messy, docs.limit(0)):
            out = step(spark, table, DATA)
            assert name == "BPE encoding and decoding" or out.columns == table.columns
            n = out.count()
            assert n == 0 if table is not messy else n > 0
    assert pipeline.run(spark, DATA).filter("not round_trip").count() == 0
