"""Recall of the graphs at the largest shard, on vectors without directions and of mixed norms."""

import numpy as np
import pytest

ann = pytest.importorskip("brindle.llm.ann")


@pytest.mark.parametrize("norms", ["unit", "mixed"])
def test_recall_at_a_full_shard(norms):
    r = np.random.default_rng(3)
    x = r.normal(size=(ann.SHARD_ROWS, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "mixed":
        x *= r.lognormal(0, 0.5, len(x))[:, None]
    radius = np.linalg.norm(x, axis=1).max() * (1 + 1e-9)
    graph = ann.Graph.build(ann._unit(x, 1.0, radius))
    width = graph.fitted_width(21)
    q = r.normal(size=(200, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    found, _ = graph.search(np.column_stack([q, np.zeros(200)]).astype(np.float32), 20, width)
    best = np.argsort(-(q @ x[graph.order].T), axis=1)[:, :20]
    hits = sum(len(set(a) & set(b)) for a, b in zip(found.tolist(), best.tolist(), strict=True))
    print(norms, width, hits / best.size)
    assert hits / best.size >= 0.95
