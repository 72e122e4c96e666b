"""Isotonic maps pooled in ranges against a fit of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from ebbtide.operators import calibration


def plain_fit(scores, hits):
    """Pooled mean of every distinct score, by repeated passes over neighbours."""
    values, where = np.unique(scores, return_inverse=True)
    blocks = []
    for k, (n, h) in enumerate(zip(np.bincount(where), np.bincount(where, weights=hits), strict=True)):
        blocks.append([[k], n, h])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            own = blocks.pop()
            blocks[-1] = [blocks[-1][0] + own[0], blocks[-1][1] + own[1], blocks[-1][2] + own[2]]
    return {values[k]: h / n for ks, n, h in blocks for k in ks}


def test_blocks_give_the_fit_of_all_rows(spark):
    rng = np.random.default_rng(5)
    scores = np.concatenate([rng.random(60_000), np.full(40_000, 0.375)])  # one score holds two fifths of all rows
    hits = (rng.random(len(scores)) < 0.2 + 0.5 * scores + 0.1 * np.sin(20 * scores)).astype(float)
    rows = spark.createDataFrame(list(zip(scores.tolist(), hits.tolist(), strict=True)), "s double, h double").repartition(7)
    blocks = calibration.isotonic_blocks(rows, "s", "h")
    assert blocks.count() < 3 * len(scores) ** (2 / 3)
    assert tuple(blocks.agg(F.sum("n"), F.sum("hits")).first()) == (len(scores), int(hits.sum()))
    ours = calibration.fit_isotonic(rows, "s", "h")
    spark_own = IsotonicRegression(featuresCol="s", labelCol="h", predictionCol="_iso").fit(rows)
    grid = spark.range(2001).select((F.col("id") / 1600 - 0.1).alias("s"))  # beyond both ends too
    got, want = ([r["_iso"] for r in m.transform(grid).orderBy("s").collect()] for m in (ours, spark_own))
    assert got == pytest.approx(want, abs=1e-12)
    plain = plain_fit(scores, hits)
    fitted = ours.transform(rows.select("s").distinct()).collect()
    assert all(abs(r["_iso"] - plain[r["s"]]) < 1e-12 for r in fitted)


def test_odd_scores(spark):
    rows = spark.createDataFrame(
        [(0.1, 1.0), (0.2, 1.0), (0.3, 1.0), (None, 1.0), (float("nan"), 0.0), (0.3, 0.0)], "s double, h double"
    )
    model = calibration.fit_isotonic(rows, "s", "h")
    found = [r["_iso"] for r in model.transform(rows.filter("s < 1").orderBy("s")).collect()]
    assert found == pytest.approx([0.75] * 4)
    ordered = spark.createDataFrame([(k / 10, float(k > 4)) for k in range(10)], "s double, h double")
    found = [r["_iso"] for r in calibration.fit_isotonic(ordered, "s", "h").transform(ordered.orderBy("s")).collect()]
    assert found == [float(k > 4) for k in range(10)]
