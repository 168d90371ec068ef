"""Cells and product codes against exact search."""

import numpy as np
import pytest

from brindle.operators import ivf, vectors


def frame(spark, x, first=0):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(x)), "v": x.tolist()}), "id long, v array<double>").repartition(8)


def clustered(n, dims=32, groups=400, seed=1):
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(9).normal(size=(groups, dims))
    return centres[r.integers(0, groups, n)] + 0.35 * r.normal(size=(n, dims))


def recall(found, x, asked, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sim = unit[asked] @ unit.T
    sim[np.arange(len(asked)), asked] = -np.inf
    least = dict(zip(asked.tolist(), np.sort(sim, axis=1)[:, -k], strict=True))
    return sum(r["sim"] >= least[r["qid"]] - 1e-6 for r in found) / (k * len(asked))


def test_recall_on_100_000_vectors_with_few_cells(spark):
    x = clustered(100_000)
    index = ivf.build(frame(spark, x))
    asked = np.arange(7, 100_000, 1000)
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in asked], "qid long, q array<double>")
    got = index.search(queries, 10).collect()
    assert index.probes * 10 < len(index.model.centres)
    assert recall(got, x, asked, 10) >= 0.9
    assert all(r["qid"] != r["id"] for r in got) and sorted({r["rank"] for r in got}) == list(range(1, 11))
    assert sum(1 for _ in index.table.select("id").distinct().toLocalIterator()) == 100_000


def test_every_cell_read_is_an_exact_search(spark):
    x = np.random.default_rng(2).normal(size=(600, 16))
    index = ivf.build(frame(spark, x), cells=10)
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 600, 50)], "qid long, q array<double>")
    key = lambda r: (r["qid"], r["rank"])
    right = vectors.knn(queries, frame(spark, x), 10)
    got = index.search(queries, 10, probes=10)
    same = sum(a["id"] == b["id"] for a, b in zip(sorted(got.collect(), key=key), sorted(right.collect(), key=key), strict=True))
    assert same >= 0.98 * 120  # a short list of 200 of 600 rows


def test_appended_rows_are_found_and_doubling_fits_anew(spark):
    x = clustered(1500, groups=20)
    index = ivf.build(frame(spark, x[:1000]), cells=20)
    more = index.append(frame(spark, x[1000:1100], first=1000))
    assert more is index and more.table.count() == 1100
    q = spark.createDataFrame([(-1, x[1050].tolist())], "qid long, q array<double>")
    assert more.search(q, 1).first()["id"] == 1050
    twice = more.append(frame(spark, np.concatenate([x[1100:], clustered(600, groups=20, seed=5)]), first=1100))
    assert twice is not index and twice.trained_rows == 2100 == twice.table.count()
    assert twice.search(q, 1).first()["id"] == 1050


def test_awkward_vectors(spark):
    schema = "id long, v array<double>"
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (8, [None, 1.0])]
    q = spark.createDataFrame([(6, [1.0, 2.0])], "qid long, q array<double>")
    assert [(r["id"], r["rank"]) for r in ivf.build(spark.createDataFrame(rows, schema)).search(q, 5).collect()] == [(7, 1)]
    assert ivf.build(spark.createDataFrame([], schema)).search(q, 5).count() == 0


@pytest.mark.parametrize("n", [1, 5])
def test_estimates_are_products_of_what_codes_stand_for(n):
    x = clustered(500, dims=8, groups=4)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    model = ivf.fit(x, n)
    cell, codes = model.encode(x)
    cuts = model.cuts
    back = model.centres[cell] + np.column_stack([b[codes[:, p]] for p, b in enumerate(model.books)])
    assert cuts[-1] == 8 and np.abs(back - x).max() < 0.5
    for c in set(cell.tolist()):
        own = cell == c
        assert np.allclose(model.estimates(x[:3], c, codes[own]), x[:3] @ back[own].T, atol=1e-4)
