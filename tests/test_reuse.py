"""Pictures used again: many equal hashes make no pairs."""

import random

import pytest

from brindle.operators import tidy


@pytest.mark.parametrize("seed", range(2))
def test_reuse_equals_brute_force(spark, seed):
    r = random.Random(seed)
    hashes = [r.getrandbits(62) for _ in range(4)]
    rows = [
        (r.choice("xy"), i, None if r.random() < 0.03 else r.choice(hashes) ^ r.choice([0, 0, 1, 6, 7, 255, 1023]), None if r.random() < 0.03 else r.choice([r.randrange(30), r.randrange(3000)]))
        for i in range(500)
    ]
    expected = {}
    for g, i, h, at in rows:
        near = [((h ^ k).bit_count(), abs(at - then), j) for f, j, k, then in rows if f == g and j != i and None not in (h, k, at, then)]
        near = [x for x in near if x[0] <= 7 and x[1] <= 40]
        if near:
            expected[i] = (min(near)[2], min(near)[0])
    found = tidy.reused(spark.createDataFrame(rows, "grp string, id long, h long, at long"), 7, 40).collect()
    assert {x["id"]: (x["other"], x["bits"]) for x in found} == expected and len(found) == len(expected)


def test_equal_hashes_make_no_pairs(spark, monkeypatch):
    seen = []
    pairs = tidy.near_hashes
    monkeypatch.setattr(tidy, "near_hashes", lambda rows, most=16: seen.append(rows.count()) or pairs(rows, most))
    rows = spark.range(5000).selectExpr("'x' as grp", "id", "7L as h", "id * 10 as at")
    found = {x["id"]: x["other"] for x in tidy.reused(rows, 7, 10).collect()}
    assert seen == [1] and found == {i: max(i - 1, 0) or (0 if i else 1) for i in range(5000)}
