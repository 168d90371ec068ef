"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import ann, bpe, components, hashing, mixing, near_dedup, pii, quality, suffix_dedup, toxicity, url_rules, warc
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

def names_in_use():
    """Every name that the operators' code gives to a column or reads one by, but those of documents."""
    found = set()
    for module in (bpe, hashing, mixing, near_dedup, pii, quality, suffix_dedup, toxicity, components):
        code = pathlib.Path(module.__file__).read_text()
        found |= set(re.findall(r'"([A-Za-z_][A-Za-z0-9_]*)"', code)) | set(re.findall(r"\b([a-z_]+) (?:long|int|binary|string|double|boolean|array<[a-z]+>)\b", code))
    return sorted(n for n in found if n.lower() not in ("doc_id", "text", "source", "lang", "n_chars"))


CLASHING = names_in_use()


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = words(1, 30_000)
BASE = words(2, 300)
NEAR = BASE.replace(BASE.split()[10], "changed", 1)
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "one", None), (4, "One", "b"), (5, BASE, "b"), (6, NEAR, "b"), (7, BASE, None), (8, LONG, "a"),
    (9, "mail joe.bloggs@a-b.example.com or +1 (234) 555-1234, 10.0.0.255, 256.1.1.1 and 4111 1111 1111 1111.", "c"),
    (10, "\t \n \r\n", "c"), (11, "x" * 5000 + " " + "1" * 5000 + "@" + "2." * 500 + "com", "c"), (12, "é𝔘ñ 漢字 \U0001f642 " * 40, "d"),
    (13, "<|endoftext|> it's <|endoftext|>", "d"), (14, "same line here\n" * 30, "d"), (15, "a@b.com_x@y.zz a@b 1.2.3.4.5.6.7.8 +12", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return rows.select("*", F.lit("fr").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def messy(docs):
    """Rows with a null in each column, and every row twice."""
    nulls = docs.filter("doc_id in (5, 9)").withColumn("doc_id", F.lit(None).cast("long"))
    twice = docs.unionByName(docs).unionByName(nulls)
    return twice.withColumn("lang", F.lit(None).cast("string"))


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def test_near_duplicates(docs, empty, messy):
    got = by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    expected = {i: (n, c, i == c) for i, (n, c) in brute.near_components([r[:2] for r in ROWS]).items()}
    assert got == expected
    assert got[7] == (len(brute.shingles(BASE)), 5, False) and got[4][1] == 3 and got[1] == (0, 1, True)
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = near_dedup.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = near_dedup.keep_first(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c, k) in expected.items() if k) and ids.count(None) == 2


def test_near_duplicates_with_many_near_copies(spark):
    r = random.Random(3)
    base = words(5, 120).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(10_000 + i, " ".join(base[:4]) + " " + words(100 + i, r.randint(1, 12))) for i in range(60)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.near_components(rows)


def test_pii(docs, empty, messy):
    found = {r["doc_id"]: r["_spans"] for r in pii.find(docs).collect()}
    for i, text, _ in ROWS:
        base = [(s["kind"], s["start"], s["end"]) for s in found[i] if s["base"]]
        assert sorted(base) == sorted(brute.base_spans(text)), i
    assert pii.find(empty).count() == 0 and pii.find(messy).count() == messy.count()
    assert {"start", "kind"} <= {f.name for f in pii.find(docs).schema["_spans"].dataType.elementType.fields}
    masked = by_id(pii.redact(docs), "text", "n_chars")
    assert masked[9][0] == "mail <EMAIL> or <PHONE>, <IP>, 256.1.1.1 and <CARD>." and masked[9][1] == len(masked[9][0])
    assert masked[1] == (None, None) and masked[5][0] == BASE
    assert pii.redact(messy).columns == messy.columns


def test_bpe(docs, empty, messy):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = by_id(bpe.decode(bpe.encode(docs, PATH), PATH), "ids", "decoded")
    for i, text, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False)), i
    assert bpe.encode(empty, PATH).count() == 0 and bpe.encode(messy, PATH).count() == messy.count()
    once = bpe.recode(docs, PATH)
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # one worker a task
    assert by_id(once, "ids", "decoded") == got and bpe.recode(empty, PATH).count() == 0
    assert bpe.recode(messy, PATH).columns == [*[c for c in messy.columns if c.lower() not in ("ids", "decoded")], "ids", "decoded"]


def test_bpe_on_random_words(spark):
    from tokenizers import Tokenizer

    library, vocabulary, r = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH), random.Random(9)
    letters = "etaoin shrdlu'.,!?\n\t0123456789éßñ漢🙂_-=\x00\u00a0THE"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    ids, counts = vocabulary.encode_batch(texts)
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert len(counts) == len(texts)


def test_quality(docs, empty, messy):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, text, _ in ROWS:
        q = got[i]["_q"]
        expected = brute.quality(text)
        assert tuple(q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected, i
        assert got[i]["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert got[5]["kept"] and got[8]["kept"]
    assert quality.judge(empty).count() == 0 and quality.judge(messy).count() == messy.count()
    assert quality.keep_good(messy).columns == messy.columns


def test_nearest(spark):
    r = random.Random(4)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    vectors += [(1000 + i, [1.0] * 8) for i in range(60)]  # ties: equal vectors
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (None, [1.0] * 8), (2004, [float("inf")] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    rows = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    hits = total = 0
    known = dict(vectors)
    for q in (i for i in known if i % 20 == 0):
        dot = {i: sum(a * b for a, b in zip(known[q], v, strict=True)) for i, v in vectors if i != q}
        best = sorted(dot, key=lambda i: (-round(dot[i], 9), i))[:20]
        own = sorted((x for x in rows if x["query_id"] == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == list(range(1, 21))
        assert all(abs(x["score"] - dot[x["vec_id"]]) < 1e-9 for x in own)
        hits, total = hits + len(set(best) & {x["vec_id"] for x in own}), total + 20
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert ann.nearest(few, few, k=20).count() == 6


def test_warc(spark, tmp_path):
    big = "<p>WARC/1.1\r\n\r\n" + "é" * 1000
    rows = [(1, "http://a.com/x\r\ny", big), (2, None, big), (3, "http://b.com", "small"), (4, "http://b.com", "small"), (5, "u", None), (3, "http://b.com", "small"), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("digest", F.lit(""))
    for name, table in (("all", pages), ("none", pages.limit(0))):
        path = f"file://{tmp_path}/{name}"
        warc.write_archives(table, path)
        captures = warc.assemble(warc.read_records(spark, path))
        got = sorted((r["metadata"]["key"], r["response"]["type"], r["response"]["payload_bytes"], r["digest_fits"], r["origin"] and r["origin"]["fields"]["key"]) for r in captures.collect())
        if name == "none":
            assert got == []
    assert got == []
    got = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/all")).collect()
    kinds = sorted((r["metadata"]["key"], r["response"]["type"], r["origin"]["fields"]["key"] if r["response"]["type"] == "revisit" else "") for r in got)
    assert kinds == sorted([("1", "revisit", "2"), ("2", "response", ""), ("3", "response", ""), ("3", "response", ""), ("4", "response", ""), ("5", "response", ""), ("", "revisit", "2")])
    assert all(r["digest_fits"] for r in got)
    payload = next(r["response"]["payload"] for r in got if r["metadata"]["key"] == "2")
    assert bytes(payload).decode() == big


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")], "host string, path string, verdict string")
    urls = {
        "http://EXAMPLE.com/en/x?q#f": "example.com/en/", "https://www.example.com/en/": "www.example.com/en/", "https://a.www.example.com/en/1": "www.example.com/en/", "http://notexample.com/en/1": "com/",
        "http://example.com": None, "http://com/": "com/", "x.net/es/": None, "ftp://x.net/es/a": "net/es/", "http://x.net/fr/": None, "://": None, "": None, None: None, "http://com.net.org/es/": None, "a://b://net/es/": None,
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(list(urls) * 2)], "page_id long, url string").select("*", F.lit(1).alias("key"), F.lit(2).alias("host"), F.lit(3).alias("stack"))
    got = {r["url"]: r["rule"] for r in url_rules.judge(pages, rules).collect()}
    assert got == urls and url_rules.judge(pages, rules).count() == 2 * len(urls)
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_suffix_dedup(docs, empty, messy, spark):
    rows = [*(r[:2] for r in ROWS), (16, "z" * 400), (17, "q" + "z" * 120), (18, BASE[:49]), (19, BASE[100:150]), (20, "ab" * 100 + BASE[500:600] + LONG[3000:3060])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(suffix_dedup.deduplicate(frame), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(rows)
    kept = by_id(suffix_dedup.deduplicate(frame), "kept")
    assert all(hashlib.sha256(bytes(kept[i][0])).hexdigest() == got[i][3] for i in got)
    assert suffix_dedup.deduplicate(empty).count() == 0
    again = suffix_dedup.deduplicate(messy).collect()
    assert len(again) == messy.count() and all(r["n_removed"] == 0 for r in again if r["doc_id"] is None)


def test_suffix_dedup_with_colliding_hashes_and_hot_anchors(spark):
    r = random.Random(18)
    shared = words(77, 40)
    rows = [(i, words(500 + i, r.randint(2, 30)) + " " + shared[r.randint(0, 30) :] + " " + words(900 + i, r.randint(2, 30))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.suffix(rows)
    # With 2 bits, contexts that differ have one hash; only the comparison of bytes can tell.
    assert set(suffix_dedup.removable(frame, first_bits=2).select("turn").distinct().collect()) == {(1,)}
    for options in ({"first_bits": 2}, {"hot_rows": 3}, {"hot_rows": 10}):
        assert by_id(suffix_dedup.deduplicate(frame, **options), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_suffix_dedup_random(spark):
    r = random.Random(8)
    pool = [words(50 + i, 25) for i in range(12)]
    rows = [(i, " ".join(r.choice(pool)[r.randint(0, 60) :][: r.randint(10, 120)] + words(1000 + i * 9 + k, r.randint(0, 6)) for k in range(r.randint(0, 6)))) for i in range(120)]
    got = by_id(suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix(rows)


def test_toxicity(spark, docs, empty):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w, toxic = words(3000 + i, 60).split(), i % 4 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["nasty", "vile", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, LONG)], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    trained = toxicity.train(frame, known)
    got = by_id(toxicity.score(frame, trained), "score", "predicted")
    held = {x["doc_id"] for x in frame.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    right = [got[i][1] == y for i, y in labels if i in held]
    assert len(got) == 403 and sum(right) / len(right) > 0.9
    assert all(0 <= s <= 1 for s, _ in got.values()) and got[1000] == got[1001]
    assert toxicity.score(docs, trained).count() == len(ROWS) and toxicity.score(empty, trained).count() == 0
    untaught = toxicity.train(frame, known.limit(0))
    assert toxicity.score(frame, untaught).count() == 403


def test_mixing(docs, empty, messy, spark):
    for table in (docs, messy):
        rows = mixing.mix(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            m = r["_mix"]
            assert m["size"] == len(brute.WORD.findall(r["text"] or "")) and 0 <= m["taken"] <= 2 * m["size"]
        targets = {r["source"]: r["_mix"]["target"] for r in rows}
        sizes = {s: sum(r["_mix"]["size"] for r in rows if r["source"] == s) for s in targets}
        assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values()) and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in targets)
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0
    many = spark.createDataFrame([(i, words(i, 5 + i % 40), f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.mix(many).collect()
    for s in {r["source"] for r in rows}:
        own = [r["_mix"] for r in rows if r["source"] == s]
        assert abs(sum(m["taken"] for m in own) - own[0]["target"]) <= 5  # the shortest document
    assert mixing.sample(many).columns == many.columns
    assert sorted(map(str, mixing.mix(many).collect())) == sorted(map(str, rows))


def test_budget_fitting():
    assert mixing.fit_counts([3, 5], [10, 10], 0) == [0, 0]
    assert mixing.fit_counts([3, 5], [2, 2], 100) == [2, 2]
    r = random.Random(1)
    for _ in range(200):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 8)))
        counts = [r.randint(1, 6) for _ in lengths]
        budget = r.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        taken = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert abs(sum(n * t for n, t in zip(lengths, taken, strict=True)) - budget) <= max(lengths)


def test_runs_of_one_source_are_joined_over_parts():
    import numpy as np

    x = lambda *v: np.array(v, np.int64)
    # Two anchors of text 0 that met in different groups overlap; one of text 1, one of another source and one of another distance don't join.
    got = suffix_dedup.sure_runs(x(0, 1, 0, 0, 0), x(100, 100, 30, 100, 100), x(7, 7, 7, 8, 7), x(5, 5, 5, 5, 6), x(120, 400))
    assert sorted(zip(*(c.tolist() for c in got), strict=True)) == [(0, 4, 120, 7, 5), (0, 74, 120, 7, 6), (0, 74, 120, 8, 5), (1, 74, 150, 7, 5)]
