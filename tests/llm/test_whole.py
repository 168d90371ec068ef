"""Inputs that a shortcut would miss."""

import itertools
import random

from brindle.llm import mixing, near_dedup, pii
from tests.llm import brute

CARD = "4111111111111111"


def test_cards_in_short_groups(spark):
    groups = lambda n, sep: sep.join(CARD[i : i + n] for i in range(0, 16, n))
    r, texts = random.Random(8), [f"a {groups(n, sep)} b" for n in (1, 2, 3, 4, 8, 16) for sep in " -"]
    texts += ["card " + groups(2, " ") + " and 41 11", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1", groups(2, "  "), groups(1, " ") + " 1 1 1 1", "é𝔘 " + groups(2, "-")]
    texts += ["".join(r.choice(["0", "4", "1", "9", " ", "-", "x"]) for _ in range(r.randint(0, 200))) for _ in range(300)]
    texts += ["x ".join(groups(r.randint(1, 2), r.choice(" -")) for _ in range(3)) for _ in range(20)]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r["_spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cards = 0
    for i, text in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in found[i] if s["base"]]
        assert sorted(base) == sorted(brute.base_spans(text)), text
        cards += len(base)
    assert cards > 60
    masked = pii.redact(spark.createDataFrame([(1, "pay 41 11 11 11 11 11 11 11 now")], "doc_id long, text string")).first()
    assert masked["text"] == "pay <CARD> now"


def distance(lengths, taken, budget):
    return abs(sum(n * t for n, t in zip(lengths, taken, strict=True)) - budget)


def test_budgets_of_very_long_documents(monkeypatch):
    for bits in (mixing.TABLE_BITS, 0):  # by the whole table, and by drawing down
        monkeypatch.setattr(mixing, "TABLE_BITS", bits)
        assert [mixing.fit_counts([1_000_000], [1], b) for b in (400_000, 500_000, 600_000)] == [[0], [0], [1]]
        assert mixing.fit_counts([1_000_000, 10], [1, 1000], 600_000) == [1, 0]
        assert mixing.fit_counts([300_000, 1_000_000], [1, 1], 700_000) == [0, 1]
        assert mixing.fit_counts([400_000], [1], 260_000) == [1]  # just below twice the table
        assert mixing.fit_counts([80_000], [3], 140_000) == [2]
    r = random.Random(6)
    for bits in (1 << 28, 0):
        monkeypatch.setattr(mixing, "TABLE_BITS", bits)
        for _ in range(300):
            lengths = sorted(r.sample(range(100_000, 1_500_000), r.randint(1, 3)))
            counts = [r.randint(1, 2) for _ in lengths]
            budget = r.randint(0, distance(lengths, counts, 0))
            best = min(distance(lengths, c, budget) for c in itertools.product(*[range(n + 1) for n in counts]))
            taken = mixing.fit_counts(lengths, counts, budget)
            assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
            assert distance(lengths, taken, budget) == best if bits else distance(lengths, taken, budget) <= max(lengths) / 2


def test_mix_of_one_very_long_document(spark):
    for source_words, taken in ((400_000, 0), (600_000, 1_000_000), (1_400_000, 1_000_000)):
        text = "w " * 1_000_000
        # fit() sees the source's size and its target only.
        histogram = spark.createDataFrame([("1a", 1_000_000, 1)], "_s string, size long, n long")
        targets = spark.createDataFrame([("1a", 1_000_000, float(source_words))], "_s string, source_size long, target double")
        row = mixing.take_plan(histogram, targets).first()
        assert (row["rounds"] + row["extra"]) * len(text) // 2 == taken


def test_short_texts_among_many_that_are_loosely_alike(spark):
    """A pair of 66 and 58 shingles, and in each of their buckets a smaller doc_id that neither links with."""
    r = random.Random(12)
    base = [f"b{i}" for i in range(67)]
    rows = []
    for i in range(2500):
        changed = set(r.sample(range(67), 25))
        rows.append((i, " ".join(f"x{i}_{j}" if j in changed else w for j, w in enumerate(base))))
    rows += [(10_000, " ".join(base)), (10_001, " ".join(base[:57]) + " y0 y1")]
    a, b = (brute.shingles(t) for _, t in rows[-2:])
    assert len(a) >= near_dedup.TRUST_FROM > len(b) and len(a & b) >= 0.8 * len(a | b)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near_components(rows)
