"""Nearest neighbours and synthetic rows against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ebbtide.operators import balancing, neighbours


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>").repartition(5)


def brute(x, k):
    out = {}
    for i, row in enumerate(x):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        d[i] = np.inf
        out[i] = [(round(d[j], 9), int(j)) for j in np.lexsort((np.arange(len(x)), d))[:k] if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("n, range_rows", [(500, 2000), (500, 40), (3, 2000), (1, 2000), (6, 2)])
def test_same_neighbours_as_all_pairs(spark, n, range_rows):
    x = np.round(np.random.default_rng(n).normal(size=(n, 3)), 3)
    found = {r["id"]: [(round(a["distance"], 9), a["id"]) for a in r["neighbours"]] for r in neighbours.nearest(frame(spark, x), 5, range_rows).collect()}
    assert found == brute(x, 5)


def test_ranges_are_crossed_and_ties_go_by_id(spark):
    """Points on one plane across the direction all have one projection; many points repeat."""
    x = np.random.default_rng(2).integers(0, 4, size=(300, 2)).astype(float)
    found = {r["id"]: [(round(a["distance"], 9), a["id"]) for a in r["neighbours"]] for r in neighbours.nearest(frame(spark, x), 4, 25).collect()}
    assert found == brute(x, 4)


def test_synthetic_rows_lie_between_true_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(60, 3)), rng.normal(size=(23, 3)) + 4]
    label = np.r_[np.zeros(60), np.ones(23)]
    df = spark.createDataFrame([([float(v) for v in r], float(y)) for r, y in zip(x, label, strict=True)], "v array<double>, label double")
    df = df.withColumn("features", array_to_vector("v")).drop("v").repartition(3)
    out = balancing.oversample(df).select("label", vector_to_array("features").alias("v")).collect()
    assert sum(r["label"] == 1 for r in out) == 60 == sum(r["label"] == 0 for r in out)
    again = balancing.oversample(df.repartition(2)).select("label", vector_to_array("features").alias("v")).collect()
    key = lambda rows: sorted((r["label"], tuple(np.round(r["v"], 9))) for r in rows)
    assert key(out) == key(again)
    own = x[60:]
    near = brute(own, 5)
    kept = {tuple(np.round(v, 9)) for v in own}
    new = [np.array(r["v"]) for r in out if r["label"] == 1 and tuple(np.round(r["v"], 9)) not in kept]
    assert len(new) == 37
    for v in new:
        assert any(
            np.abs(np.cross(v - own[i], own[j] - own[i])).max() < 1e-9 and -1e-9 <= (v - own[i]) @ (own[j] - own[i]) <= (own[j] - own[i]) @ (own[j] - own[i]) + 1e-9
            for i in range(23) for _, j in near[i]
        )
