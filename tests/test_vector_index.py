"""Nearest vectors from lists against all pairs."""

import numpy as np
import pytest

from colloq.operators import vector_index


@pytest.mark.parametrize("lists,block,k", [(16, 1024, 5), (3, 7, 40), (64, 50, 1)])
def test_equal_to_all_against_all(spark, lists, block, k):
    rng = np.random.default_rng(lists)
    centers = rng.normal(size=(12, 8)) * 3
    x = np.concatenate((centers[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)) * 0.3, np.tile(centers[:1], (60, 1)), rng.normal(size=(40, 8))))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] + [1.0] * 7), (9003, [None] + [1.0] * 7)]
    frame = spark.createDataFrame(rows, "i long, v array<double>").repartition(4)
    index = vector_index.build(frame, "i", "v", lists)
    report: list = []
    found = vector_index.search(index, frame.filter("i % 8 = 0 or i >= 9000"), "i", "v", k, block, report).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got: dict = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got.keys() == set(range(0, 800, 8))
    for q, best in got.items():
        s = u @ u[q]
        assert len(best) == k and np.allclose([v for _, v in best], np.sort(s)[::-1][:k])
        assert all(abs(s[i] - v) < 1e-12 for i, v in best) and len({i for i, _ in best}) == k
    assert 0 < min(report) and (lists != 16 or max(report) < 0.6)  # most lists are not read
    assert vector_index.search(vector_index.build(frame.limit(0), "i", "v"), frame, "i", "v", 3).count() == 0
    assert vector_index.search(index, frame.limit(0), "i", "v", 3).count() == 0
