"""Recall and effort of the inverted multi-index at its default settings, and its traversal against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import neighbours


def brute(x, k):
    queries = np.arange(0, len(x), 20)
    score = x[queries].astype(np.float64) @ x.T.astype(np.float64)
    score[np.arange(len(queries)), queries] = -np.inf
    return {(int(q), int(i)) for q, row in zip(queries, score, strict=True) for i in np.argpartition(-row, k)[:k]}


def vectors(kind, n, d=64):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, d))
    if kind == "clusters":
        x = rng.standard_normal((200, d))[rng.integers(0, 200, n)] + 0.7 * x
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("kind, most", [("no clusters", 0.32), ("clusters", 0.1)])
def test_recall_and_share_at_default_settings(spark, tmp_path, monkeypatch, kind, most):
    x = vectors(kind, 24_000)
    shares = []
    monkeypatch.setattr(neighbours, "share_for", lambda *a, real=neighbours.share_for: shares.append(real(*a)) or shares[-1])
    import pandas as pd

    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    got = neighbours.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 20 == 0).collect()
    found, want = {(r.query_id, r.vec_id) for r in got}, brute(x, 20)
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    assert shares[0] <= most


def test_visits_are_the_nearest_pairs_of_runs():
    rng = np.random.default_rng(1)
    near1, near2 = rng.standard_normal(70), rng.standard_normal(50)
    counts = rng.integers(0, 4, (70, 50)).astype(np.int32)
    for wanted in (1, 100, 1500, 10**6):
        run1, run2, reach = neighbours.visit(near1, near2, counts, wanted)
        visited = run2[None, :] < reach[run1][:, None]
        assert counts[visited].sum() >= min(wanted, counts.sum())
        mean = [np.array([n[r == i].mean() for i in range(r.max() + 1)]) for n, r in ((near1, run1), (near2, run2))]
        total = mean[0][:, None] + mean[1][None, :]
        inside = np.arange(len(mean[1]))[None, :] < reach[:, None]
        assert not inside.any() or inside.all() or total[inside].min() >= total[~inside].max()
        if inside.sum() > 1:  # it stops as soon as there are enough
            worst = np.unravel_index(np.where(inside, total, np.inf).argmin(), total.shape)
            last = (run1[:, None] == worst[0]) & (run2[None, :] == worst[1])
            assert counts[visited & ~last].sum() < wanted
