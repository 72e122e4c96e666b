"""Second-order boosting and tree contributions against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbtide.operators import boosting, trees
from ebbtide.operators.boosting import Params


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 6)), 2)
    x[:, 5] = rng.integers(0, 3, 400)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int) + (x[:, 3] > 1).astype(int)
    return x, label, rng.integers(0, 4, 400)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, label, fold = data
    rows = [(k, [float(v) for v in x[k]], float(label[k]), int(fold[k])) for k in range(len(x))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label double, fold int")
    return df.withColumn("features", array_to_vector("v")).repartition(3).cache()


def keys_of(spark, n):
    found = spark.range(n).select(F.xxhash64(F.col("id").cast("string")).alias("k")).collect()
    return np.array([r["k"] for r in found])


def plain(x, label, key, cuts, p, outputs, candidate, seed=42):
    """Boosting row by row and bin by bin."""
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin = np.zeros((len(x), outputs))
    for round_ in range(p.rounds):
        g, h = boosting.gradients(margin, label)
        change = np.zeros_like(margin)
        for k in range(outputs):
            s = boosting.tree_seed(seed, candidate, round_, k)
            use = boosting.drawn_rows(key, s, p.rows)
            columns = np.flatnonzero(boosting.drawn_columns(x.shape[1], s, p.columns))

            def weight(rows):
                own = rows & use
                return -boosting.soft(g[own, k].sum(), p.alpha) / (h[own, k].sum() + p.lambda_) * p.step

            def grow(rows, depth):
                own = rows & use
                best = (0.0, None)
                if depth < p.depth:
                    for f in columns:
                        for b in range(max(len(c) for c in cuts) + 1):
                            left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                            hl, hr = h[left, k].sum(), h[right, k].sum()
                            if hl < p.min_child_weight or hr < p.min_child_weight:
                                continue
                            part = [boosting.soft(g[r, k].sum(), p.alpha) ** 2 / (h[r, k].sum() + p.lambda_) for r in (left, right, own)]
                            gain = round(0.5 * (part[0] + part[1] - part[2]), 10)
                            if gain > best[0]:
                                best = (gain, (f, b))
                if best[1] is None:
                    change[rows, k] = weight(rows) if depth else weight(rows)
                    return
                f, b = best[1]
                grow(rows & (bins[:, f] <= b), depth + 1)
                grow(rows & (bins[:, f] > b), depth + 1)

            grow(np.ones(len(x), dtype=bool), 0)
        margin += change
    return margin


CANDIDATES = [
    Params(rounds=6, depth=3, step=0.3), Params(rounds=4, depth=2, step=0.1, alpha=0.5, lambda_=3.0, rows=1.0, columns=1.0, min_child_weight=8.0),
]


@pytest.mark.parametrize("n_classes", [2, 3])
def test_matches_plain_boosting(spark, frame, data, n_classes, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 4)
    monkeypatch.setattr(boosting, "TASK_ROWS", 150 if n_classes == 2 else 1000)
    x, label, _ = data
    label = np.minimum(label, n_classes - 1)
    df = frame.withColumn("label", F.least("label", F.lit(n_classes - 1.0)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.1, 0.9, 9))) for k in range(x.shape[1])]
    fitted = boosting.fit(df, n_classes, CANDIDATES, F.col("id").cast("string"), cuts=cuts)
    key = keys_of(spark, len(x))
    for c, (p, ensemble) in enumerate(zip(CANDIDATES, fitted, strict=True)):
        expected = plain(x, label, key, cuts, p, 1 if n_classes == 2 else 3, c)
        assert np.allclose(ensemble.score(x), expected, atol=1e-9)
    got = trees.scored(df, fitted[0]).orderBy("id").collect()
    assert np.allclose([r["margins"] for r in got], fitted[0].score(x))
    shares = df.select(boosting.probabilities(F.array(*[F.lit(0.5)] * fitted[0].outputs), n_classes).alias("p")).first()["p"]
    assert len(shares) == n_classes and abs(sum(shares) - 1) < 1e-12


def test_held_folds_do_not_train(frame, data):
    """A candidate that holds a fold equals one trained without its rows."""
    x, _, fold = data
    df = frame.withColumn("label", F.least("label", F.lit(1.0)))
    cuts = [np.unique(np.quantile(x[:, k], [0.25, 0.5, 0.75])) for k in range(x.shape[1])]
    p = Params(rounds=3, depth=2, rows=1.0, columns=1.0)
    both = boosting.fit(df, 2, boosting.with_folds(p, 2), F.col("id"), F.col("fold"), cuts=cuts)
    for k in range(2):
        alone = boosting.fit(df.where(F.col("fold") != k), 2, [p], F.col("id"), cuts=cuts)[0]
        assert np.allclose(alone.score(x), both[k].score(x))
    assert not np.allclose(both[0].score(x), both[1].score(x))


def walk(ensemble, row):
    """Contributions by following one row down every tree."""
    total, base = np.zeros((len(row), ensemble.outputs)), np.zeros(ensemble.outputs)
    for node in ensemble.root:
        base += ensemble.value[node]
        while ensemble.feature[node] >= 0:
            f = ensemble.feature[node]
            child = ensemble.left[node] if row[f] <= ensemble.threshold[node] else ensemble.right[node]
            total[f] += ensemble.value[child] - ensemble.value[node]
            node = child
    return total, base


def test_contributions_sum_to_the_forests_probabilities(frame, data, monkeypatch):
    monkeypatch.setattr(trees, "STEP_CELLS", 100)
    x, _, _ = data
    model = RandomForestClassifier(numTrees=7, maxDepth=4, seed=1).fit(frame)
    ensemble = trees.of_forest(model)
    probability = {r["id"]: r["probability"].toArray() for r in model.transform(frame).collect()}
    rows = trees.contributions(frame, ensemble).select(
        "id", "contributions", trees.strongest(F.col("contributions"), list("abcdef"), 3).alias("top")
    ).collect()
    assert len(rows) == len(x)
    for r in rows:
        total, base = walk(ensemble, x[r["id"]])
        got = np.array(r["contributions"]).T
        assert np.allclose(got, total)
        assert np.allclose(base + got.sum(axis=0), probability[r["id"]])
        size = np.abs(total).mean(axis=1)
        order = sorted(range(6), key=lambda k: (-round(size[k], 6), "abcdef"[k]))[:3]
        assert [t["feature"] for t in r["top"]] == ["abcdef"[k] for k in order]


def test_parts_join(frame, data):
    x, _, _ = data
    df = frame.withColumn("label", F.least("label", F.lit(1.0)))
    a, b = boosting.fit(df, 2, [Params(rounds=2), Params(rounds=3, depth=2)], F.col("id"))
    assert np.allclose(trees.joined([a, b]).score(x), a.score(x) + b.score(x))
