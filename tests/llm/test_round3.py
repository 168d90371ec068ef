"""HTML extraction, importance resampling and vector codes against brute force and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

dom = pytest.importorskip("brindle.llm.dom")
from brindle.llm import html_text, importance, vector_codes  # noqa: E402

DATA = "/root/testdata/sf0.001"
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- trees


def said(page):
    tree = dom.parse(page)
    return [t for t, a in zip(tree.text, tree.aside, strict=True) if t and not a]


def test_blocks_of_broken_pages():
    assert said("<article><h1>T</h1><p>a <b>b</b>c<p>x &amp; y &am</article> tail") == ["T", "a bc", "x & y &am", "tail"]
    assert said("<div>one<aside>no</aside>two<p>three<br>four</div><div class='top ad'>ad</div>") == ["one", "two", "three four"]
    assert said("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert said('<p>a <span class="ad">no<span>no</span>no</span> b') == ["a", "b"]
    assert said('<script>var t="</p>";</script>k<style>x') == ["k"]
    assert said('<p title="a > b">t</p><p class="x>broken</p> z') == ["t", "broken", "z"]
    assert said("a < b <1<!-- <p>no --> c<?x y?></ >") == ["a < b <1 c"]
    assert said("<header><h1>no</h1></header><article><header><h1>H</h1><p>by</p></header><p>t</p><div id=comments><article>no</article></div>") == ["H", "t"]
    assert said("<form><p>no</form><p hidden>no</p><p>yes<") == ["yes<"]
    assert said("") == [] and len(said("<div>x" * 3000)) == 3000 and max(dom.parse("<div>x" * 3000).depth) == dom.DEEPEST
    assert said("<p>x" + "<b>y" * 20_000) == ["x" + "y" * 20_000]


def plain_match(a, b):
    """Most nodes in a matching of two (tag, text, children) trees, equal texts counting twice."""
    if a[0] != b[0]:
        return 0
    m = np.zeros((len(a[2]) + 1, len(b[2]) + 1))
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + plain_match(x, y))
    return m[-1, -1] + 1 + (a[1] == b[1])


def random_tree(r, depth=3):
    return r.choice("ab"), r.randrange(3), [random_tree(r, depth - 1) for _ in range(r.randint(0, 4))] if depth else []


def flat(tree):
    tags, parents, texts = [], [], []

    def add(node, parent):
        tags.append(node[0])
        parents.append(parent)
        texts.append(node[1])
        own = len(tags) - 1
        for child in node[2]:
            add(child, own)

    for child in tree[2]:
        add(child, -1)
    return tags, parents, texts


@pytest.mark.parametrize("cells", [10**6, 4])
def test_simple_tree_matching(cells, monkeypatch):
    monkeypatch.setattr(dom, "CELLS", cells)
    r = random.Random(1)
    for _ in range(150):
        a, b = ("r", 0, random_tree(r)[2]), ("r", 0, random_tree(r)[2])
        (t, p, x), (t2, p2, x2) = flat(a), flat(b)
        to = dom.match(t, p, x, t2, p2, x2)
        pairs = [(i, j) for i, j in enumerate(to) if j >= 0]
        for i, j in pairs:
            assert t[i] == t2[j] and (p[i] == -1) == (p2[j] == -1) and (p[i] == -1 or to[p[i]] == p2[j])
        assert all(j < k for (h, j), (i, k) in zip(pairs, pairs[1:], strict=False) if p[h] == p[i])
        if cells > 4:
            assert sum(1 + (x[i] == x2[j]) for i, j in pairs) == plain_match(a, b) - 2


# ---- pages


def page(n, host="h.com", notice="Read our house rules before you write.", body=None):
    r = random.Random(n)
    texts = body or [" ".join(r.choice(["sea", "sky", "wood", "iron"]) + str(r.randrange(999)) for _ in range(12)) for _ in range(r.randint(2, 5))]
    html = f"<html><body><nav><a href=/>Home</a></nav><div id=c><h1>Story {n}</h1>" + "".join(f"<p>{t}</p>" for t in texts) + f"<p>{notice}</p></div><footer>f{n}</footer></body></html>"
    return (n, f"http://{host}/{n}", html), " ".join([f"Story {n}", *texts])


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_goes_and_content_stays(spark):
    pages = [page(n) for n in range(12)] + [page(n, host=f"single{n}.com") for n in (20, 21)]
    got = extracted(spark, [p for p, _ in pages])
    for (n, *_), text in pages:
        assert got[n] == (text if n < 20 else text + " Read our house rules before you write.")


def test_copies_of_a_page_are_no_template(spark):
    same = page(1)
    near = [(100 + n, f"http://h.com/{n}", same[0][2].replace("Story 1", f"Story {n}")) for n in range(9)]
    got = extracted(spark, [(n, f"http://h.com/c{n}", same[0][2]) for n in range(40)] + near)
    notice = " Read our house rules before you write."
    assert all(got[n] == same[1] + notice for n in range(40))
    assert all(got[100 + n] == same[1].replace("Story 1", f"Story {n}") + notice for n in range(9))


def test_articles_of_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    import html

    from brindle.llm import queries

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op11_html_text(spark, DATA).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        text = " ".join(b for b in blocks if b)
        assert got[r["page_id"]] == (text, len(text))


def test_awkward_pages(spark):
    (n, url, html), text = page(3)
    rows = [(1, None, html), (2, url, None), (3, url, ""), (None, url, html), (4, url, html), (4, url, html), (5, "no host", "<p>" + "x " * 200_000), (6, url, "<" * 5000)]
    names = ["given", "host", "tree", "texts", "sig", "whole", "content", "spread", "blocks", "text", "n_chars", "salt", "parts", "slots", "left"]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(7).alias(c) for c in names])
    out = html_text.extract(df)
    assert set(out.columns) == set(df.columns) - {"html"}
    got = out.collect()
    assert len(got) == len(rows) and all(r["salt"] == 7 and r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[2] == by_id[3] == "" and by_id[1].startswith(text) and by_id[5] == " ".join(["x"] * 200_000) and by_id[6] == "<" * 5000
    assert html_text.extract(df.limit(0)).count() == 0


# ---- resampling


def features_of(text, n):
    w = FEATURE.findall((text or "").translate(brute.LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, n=1, buckets=10_000, percent=10, least=20):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in docs:
        np.add.at(s, [code(f) for f in features_of(text, n)], 1)
    for text in target:
        np.add.at(t, [code(f) for f in features_of(text, n)], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, text in docs:
        f = features_of(text, n)
        weight = sum(gain[code(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(features_of(text, 1)) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for r, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = r + 1
    return sorted(map(tuple, out), key=repr)


TEXTS = [None, "", "One, two;three", "Ünïcode ÄÖ \U0001f642 İx " * 9, "a b c " * 15, "same words again " * 30, "same words again " * 30, "\x00\x7f z9-z9 " * 25, "x" * 100_000, "w " * 60_000]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, n):
    r = random.Random(n)
    docs = list(enumerate(TEXTS)) + [(i, " ".join(r.choice("red green blue grey low high".split()) + str(r.randrange(40)) for _ in range(r.randint(1, 80)))) for i in range(20, 300)]
    target = ["red1 red2 low3 " * 5, None, "zz"]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("_words", "_key", "_text", "_score", "given", "rank", "n_features")])
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    out = importance.resample(df, bench, n_words=n)
    assert sorted(out.columns) == sorted(set(df.columns) - {"text"} | {"weight", "score"})
    got = sorted(((x["doc_id"], x["n_features"], x["weight"], x["score"], x["rank"]) for x in out.collect()), key=repr)
    assert got == plain_resample(docs, target, n)


def test_resampling_of_repeats_nulls_and_nothing(spark):
    docs = [(i // 2, f"word{i // 2} other thing " * 10) for i in range(60)] + [(None, "null key here ok " * 10)] * 3
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("word1",)], "text string")
    rows = importance.resample(df, bench, percent=50).collect()
    ranks = sorted(x["rank"] for x in rows if x["rank"])
    assert len(rows) == 63 and ranks == list(range(1, 32))
    assert importance.resample(df.limit(0), bench).count() == 0
    assert sorted(x["weight"] for x in importance.resample(df, bench.limit(0)).collect())[0] < 0


def test_composed_crc():
    r = random.Random(5)
    for _ in range(200):
        a, b = r.randbytes(r.randint(0, 9)), r.randbytes(r.randint(0, 300))
        crc = np.array([zlib.crc32(a)], np.uint32)
        assert importance.followed(crc, np.array([zlib.crc32(b)], np.uint32), len(b))[0] == zlib.crc32(a + b)
    assert [list(map(int, w)) for _, w, _, _ in importance.scan(pa.array(["A b", None, "c"]))] == [[2, 0, 1]]


# ---- vector codes


@pytest.mark.parametrize(("scale", "entries", "dims"), [(128, 256, 16), (3, 256, 4), (40, 100, 8), (10**7, 70, 16), (2, 256, 1), (5, 1, 3)])
def test_nearest_entries(scale, entries, dims):
    r = np.random.default_rng(entries)
    x = np.floor(r.normal(size=(2000, dims)) * scale).astype(np.int64)
    far = np.square(x[:, None] - x[None, :entries]).sum(2)
    index, distance = vector_codes.Slices(x[:entries]).nearest(x)
    assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((i, tuple(math.floor(1024 * c) for c in v), label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    x = np.array([v for _, v, _ in kept], np.int64)
    width, out, error, books = x.shape[1] // parts, [""] * len(x), np.zeros(len(x), int), []
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        book = own[:entries].copy()
        for n in range(rounds + 1):
            far = np.square(own[:, None] - book[None]).sum(2)
            at = far.argmin(1)
            if n < rounds:
                for e in set(at.tolist()):
                    book[e] = own[at == e].sum(0) // (at == e).sum()
        out = [o + f"{a:02x}" for o, a in zip(out, at, strict=True)]
        error += far.min(1)
        books += book.ravel().tolist()
    total = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((i, c, int(e), total[label], sha) for (i, _, label), c, e in zip(kept, out, error, strict=True))


@pytest.mark.parametrize("n", [3, 700])
def test_vector_codes(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(r.normal(size=(n, 8)))]
    rows += [(n + i, rows[0][1], 1) for i in range(40)]
    bad = [(9000, None, 1), (9001, [None] * 8, 1), (9002, [float("nan")] * 8, None), (9003, [float("inf")] * 8, 2)]
    names = ("given", "k", "l", "x", "code", "error", "m", "codebooks_sha256")
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(7).alias(c) for c in names]).repartition(5)
    out = vector_codes.compress(df)
    assert set(out.columns) == set(df.columns) - {"embedding"} | {"label_error"}
    got = sorted((x["vec_id"], x["code"], x["error"], x["label_error"], x["codebooks_sha256"]) for x in out.collect())
    assert got == plain_codes(rows)


def test_vector_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 2.0, 3.0, 4.0], None), (1, [1e300, -1e300, 0.0, 0.0], 1), (1, [1e300, -1e300, 0.0, 0.0], 1), (2, [1.0], 1)]
    got = vector_codes.compress(spark.createDataFrame(rows, schema)).collect()
    assert sorted((x["vec_id"] is None, x["error"]) for x in got) == [(False, 0), (False, 0), (True, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], schema))
