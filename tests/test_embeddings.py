"""Means and deviations of embeddings per group."""

from __future__ import annotations

import numpy as np

from ebbtide.operators import embeddings


def test_moments_are_merged_over_tasks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MAX_GROUPS", 3)
    rng = np.random.default_rng(3)
    rows = [(f"p{k % 7}" if k % 11 else None, k % 3, (1e4 + rng.normal(size=5)).tolist() if k % 13 else None) for k in range(400)]
    frame = spark.createDataFrame(rows, "p string, m int, embedding array<double>").repartition(5)
    found = embeddings.embedding_features(frame, ["p", "m"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan  # they sort whole rows beyond 128 groups
    got = {(r["p"], r["m"]): r for r in found.collect()}
    assert set(got) == {r[:2] for r in rows}
    for key, r in got.items():
        mine = [v for *k, v in rows if tuple(k) == key]
        x = np.array([v for v in mine if v is not None])
        assert r["n_reviews"] == len(mine)
        assert np.allclose(r["embedding_mean"].toArray(), x.mean(axis=0), atol=1e-9)
        assert np.allclose(r["embedding_std"].toArray(), x.std(axis=0, ddof=1), atol=1e-7)


def test_components_read_the_features_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(embeddings, "stored", lambda df, name: made.append(name) or df.localCheckpoint())
    rng = np.random.default_rng(4)
    rows = [(k % 9, rng.normal(size=6).tolist()) for k in range(90)]
    features = embeddings.embedding_features(spark.createDataFrame(rows, "m int, embedding array<double>"), ["m"])
    out, explained = embeddings.reduce_embeddings(features, 4)
    assert out.count() == 9 and len(explained["embedding_mean"]) == 4 and made == ["embedding-features"]
