"""Jobs of boosting: rows of one task grow many rounds in a job, with the trees that a job per level grows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbtide.operators import boosting


def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    label = ((x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)).tolist()
    frame = spark.createDataFrame([(k, [float(v) for v in r], float(c), k % 3) for k, (r, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, label double, fold int")
    return frame.withColumn("features", array_to_vector("v"))


def test_rows_of_one_task_take_no_job_per_level(spark, monkeypatch):
    frame, calls, level = rows(spark).cache(), [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a, **k: calls.append(1) or level(*a, **k))
    monkeypatch.setattr(boosting, "STORE_EVERY", 3)
    candidates = [boosting.Params(rounds=4, depth=3, held=0), boosting.Params(rounds=7, depth=2, min_child_weight=1.0)]
    small = boosting.fit(frame, 3, candidates, F.col("id"), F.col("fold"))
    assert not calls
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    large = boosting.fit(frame, 3, candidates, F.col("id"), F.col("fold"))
    assert len(calls) == 4 * 3 + 3 * 2
    for a, b in zip(small, large, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.root, b.root) and np.array_equal(a.left, b.left)
        assert np.allclose(a.value, b.value) and np.allclose(a.threshold, b.threshold) and np.allclose(a.gain, b.gain)
        assert len(a.root) in (12, 21) and (a.feature >= 0).any()
