"""The fitted parts of operators 2, 4 and 9 against plain versions: span by span, row by row."""

import math
import random

from brindle.llm import pii, quality, toxicity


def test_labelers():
    """EM over single spans, each vote a row of its own, gives the posteriors that counts of patterns give."""
    r = random.Random(3)
    spans = [(r.choice(["email", "card"]), r.choice([0, 1]), r.choice([-1, 0, 1]), r.choice([-1, 0, 1]), r.randrange(5)) for _ in range(300)]
    got = pii.fit_labelers([(*s, 1) for s in spans])
    for kind in ("email", "card"):
        rows = [s[1:4] for s in spans if s[0] == kind]
        prior, right, start = 0.5, [0.8, 0.7, 0.7], [0.8, 0.7, 0.7]
        for _ in range(25):
            post = []
            for votes in rows:
                yes, no = prior, 1 - prior
                for v, p in zip(votes, right, strict=True):
                    yes *= {1: p, -1: 1 - p, 0: 1}[v]
                    no *= {1: 1 - p, -1: p, 0: 1}[v]
                post.append(yes / (yes + no))
            prior = min(0.95, max(0.05, (sum(post) + 1) / (len(rows) + 2)))
            for j in range(3):
                hits = [p if v[j] > 0 else 1 - p for v, p in zip(rows, post, strict=True) if v[j]]
                right[j] = min(0.98, max(0.55, (sum(hits) + 4 * start[j]) / (len(hits) + 4)))
        for votes, p in zip(rows, post, strict=True):
            assert math.isclose(got[(kind, *votes)], p, rel_tol=1e-9)


def test_reliabilities(spark):
    """EM over single documents gives the posteriors that counts of patterns give, and finds planted junk."""
    r, width = random.Random(4), len(quality.rule_votes())
    rows, truth = [], []
    for _ in range(400):
        good = r.random() < 0.85
        rows.append(tuple(0 if r.random() < 0.3 else (-1 if r.random() < (0.03 if good else 0.7) else 1) for _ in range(width)))
        truth.append(good)
    clip = lambda x: min(0.999, max(0.001, x))
    prior, bad, good = 0.9, [0.5] * width, [0.02] * width

    def judged(votes):
        yes, no = prior, 1 - prior
        for v, g, b in zip(votes, good, bad, strict=True):
            yes *= {-1: g, 1: 1 - g, 0: 1}[v]
            no *= {-1: b, 1: 1 - b, 0: 1}[v]
        return yes / (yes + no)

    for _ in range(30):
        post = [judged(v) for v in rows]
        prior = min(0.99, max(0.5, (sum(post) + 1) / (len(rows) + 2)))
        for j in range(width):
            cast = [(p, v[j]) for p, v in zip(post, rows, strict=True) if v[j]]
            good[j] = clip((0.1 + sum(p for p, v in cast if v < 0)) / (2 + sum(p for p, _ in cast)))
            bad[j] = max(clip((1 + sum(1 - p for p, v in cast if v < 0)) / (2 + sum(1 - p for p, _ in cast))), good[j])
    counts = {v: rows.count(v) for v in set(rows)}
    weights = quality.fit_reliabilities(sorted(counts.items()))
    assert all(math.isclose(quality.posterior(v, weights), judged(v), rel_tol=1e-6, abs_tol=1e-9) for v in counts)
    right = sum((quality.posterior(v, weights) >= 0.5) == t for v, t in zip(rows, truth, strict=True))
    assert right >= 0.95 * len(rows)


def test_smoothed_probabilities(spark):
    """Ratios of bigrams, contexts and words from the formula, one pair at a time."""
    r = random.Random(6)
    counts = {(u, v): (r.randrange(4), r.randrange(3)) for u in range(6) for v in range(9) if r.random() < 0.5}
    counts = {k: n for k, n in counts.items() if sum(n)}
    docs = {v: r.randrange(50) for v in range(8)}
    pairs, contexts, words, unknown = toxicity.log_ratios(
        spark.createDataFrame([(*k, *n) for k, n in counts.items()], "u long, v long, n0 long, n1 long"), spark.createDataFrame(list(docs.items()), "v long, docs long")
    )
    d, found = toxicity.DISCOUNT, {v for _, v in counts}
    mass = {v: math.log1p(docs.get(v, 0)) + 1 for v in found}

    def p_word(v, c):
        kinds = sum(n[c] > 0 for n in counts.values())  # bigram types of the class
        ends = lambda w: sum(n[c] > 0 for (_, x), n in counts.items() if x == w)
        free = max(d * sum(ends(w) > 0 for w in found) / max(kinds, 1), 1e-3)
        return max(ends(v) - d, 0) / max(kinds, 1) + free * mass[v] / (sum(mass.values()) + 1), free

    def context(u, c):
        mine = [n[c] for (x, _), n in counts.items() if x == u]
        return sum(mine), d * sum(n > 0 for n in mine) / sum(mine) if sum(mine) else 1.0

    def p_pair(u, v, c):
        total, backoff = context(u, c)
        n = counts[u, v]
        own = max(n[c] - d, 0) / total if total else 0.0
        return own + backoff * (sum(n) / (context(u, 0)[0] + context(u, 1)[0]) + p_word(v, c)[0]) / 2

    near = lambda got, want: math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)
    rows = pairs.collect()
    assert len(rows) == len(counts) and all(near(x.r, math.log(p_pair(x.u, x.v, 1) / p_pair(x.u, x.v, 0))) for x in rows)
    assert all(near(x.r, math.log(context(x.u, 1)[1] / context(x.u, 0)[1])) for x in contexts.collect())
    rows = words.collect()
    assert {x.v for x in rows} == found and all(near(x.r, math.log(p_word(x.v, 1)[0] / p_word(x.v, 0)[0])) for x in rows)
    assert near(unknown, math.log(p_word(min(found), 1)[1] / p_word(min(found), 0)[1]))
