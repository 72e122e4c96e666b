"""Searches over whole grids, and how many fits and fitted models a table of many rows has at a time."""

from __future__ import annotations

import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators import models, splits
from ebbtide.plans import learning


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 3))
    tired = x[:, 0] + x[:, 1] * x[:, 2] > 0
    frame = spark.createDataFrame(
        [(f"b{k}", [float(v) for v in r], float(c), specs.BINARY_CLASSES[int(c)], k % 3) for k, (r, c) in enumerate(zip(x, tired, strict=True))],
        "_id string, v array<double>, label double, _class string, _fold int",
    )
    return frame.withColumn("features", array_to_vector("v")).drop("v").cache()


def test_trained_models_are_searched_over_whole_grids(spark, monkeypatch):
    searched = {}

    def search(kind, folds, classes, choices=None, balance="weights"):
        searched[kind] = models.grid(kind, choices)
        return searched[kind][0], 0.5

    right = spark.createDataFrame([("a", "a"), ("b", "b")], "_class string, pred string")
    monkeypatch.setattr(models, "search", search)
    monkeypatch.setattr(models, "fit", lambda *a, **k: SimpleNamespace(predict=lambda df: df))
    monkeypatch.setattr(learning, "prepared", lambda t: SimpleNamespace(train=right, test=right, classes=("a", "b")))
    monkeypatch.setattr(learning, "folds", lambda t: [])
    monkeypatch.setattr(learning, "kept", lambda t, name, make: make())
    table = learning.trained(None)[1]
    assert {kind: len(points) for kind, points in searched.items()} == {"boosted_trees": 32, "random_forest": 8, "logistic_regression": 4}
    assert all(points == models.grid(kind) for kind, points in searched.items())
    assert table.count() == 3


def test_points_searched_apart_score_as_those_searched_together(rows, monkeypatch):
    """Draws of rows and columns depend on a point's place in the whole grid."""
    folds = models.k_folds(splits.stratified_folds(rows.drop("_fold"), "label", ["_id"], 2), "_fold", 2)
    choices = {"maxIter": (2, 5), "maxDepth": (2, 3), "subsamplingRate": (0.5,), "minChildWeight": (1.0,)}
    together = models.grid_scores("boosted_trees", folds, specs.BINARY_CLASSES, choices)
    monkeypatch.setattr(models, "POINTS_AT_ONCE", 1)
    assert models.grid_scores("boosted_trees", folds, specs.BINARY_CLASSES, choices) == together
    assert len({s for _, s in together}) > 1


def test_many_rows_are_fitted_one_at_a_time_and_no_model_stays(rows, monkeypatch):
    running, most, lock, fit = [0], [0], threading.Lock(), models.fit

    def counted(*a, **k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        try:
            return fit(*a, **k)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models, "fit", counted)
    monkeypatch.setattr(models, "SMALL_ROWS", 10)
    out = models.out_of_fold("decision_tree", rows, specs.BINARY_CLASSES, F.col("_fold"), 3)
    assert most[0] == 1
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()  # predictions are stored, not pending on five models
    got = {r["_id"]: r["p"] for r in out.collect()}
    assert len(got) == rows.count()
    held = fit("decision_tree", rows.where("_fold <> 1"), specs.BINARY_CLASSES).predict(rows.where("_fold = 1")).collect()
    assert all(got[r["_id"]] == pytest.approx(r["p"]) for r in held)
    models.grid_scores("decision_tree", models.k_folds(rows, "_fold", 3), specs.BINARY_CLASSES, {"maxDepth": (2, 3)})
    assert most[0] == 1
    monkeypatch.setattr(models, "SMALL_ROWS", 1000)
    models.grid_scores("decision_tree", models.k_folds(rows, "_fold", 3), specs.BINARY_CLASSES, {"maxDepth": (2, 3)})
    assert most[0] == 4
