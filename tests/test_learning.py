from __future__ import annotations

import datetime
from itertools import product

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators import (
    audit, balancing, calibration, embeddings, fusion, history, labels, metrics, models, prep, ranking, scoring, splits, tuning,
)
from ebbtide.operators.ranking import running_totals
from ebbtide.session import scratch_path
from ebbtide.sources import readers, runs, sinks, store


def months(n):
    return [datetime.date(2024 + i // 12, i % 12 + 1, 1) for i in range(n)]


def macro_f1(y, pred):
    out = []
    for c in sorted(set(y) | set(pred)):
        tp = sum(a == c and b == c for a, b in zip(y, pred))
        fp = sum(a != c and b == c for a, b in zip(y, pred))
        fn = sum(a == c and b != c for a, b in zip(y, pred))
        out.append(2 * tp / (2 * tp + fp + fn))
    return sum(out) / len(out)


@pytest.fixture(scope="module")
def probabilities():
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1.5, 1, 1], 400).round(2)
    y = [specs.CLASSES[i] for i in (p + rng.normal(0, 0.25, p.shape)).argmax(axis=1)]
    return p, y


@pytest.fixture(scope="module")
def scored(spark, probabilities):
    p, y = probabilities
    rows = [(i, [float(v) for v in row], label) for i, (row, label) in enumerate(zip(p, y))]
    df = spark.createDataFrame(rows, "id int, p array<double>, y string")
    from ebbtide.functions import probability as P

    return df.withColumn("pred", P.class_at(P.arg_max(F.col("p")), specs.CLASSES)).cache()


def test_forward_score_on_two_declining_products(spark):
    rows = []
    for pid in ("A", "B"):
        for i, m in enumerate(months(8)):
            rows.append((pid, m, 0.5 - 0.05 * i, max(1, 20 - 2 * i), -3.0 * i))
    df = spark.createDataFrame(
        rows, "ProductId string, month date, sentiment_mean double, review_count bigint, reviewer_diversity_change double"
    )
    out = labels.forward_labels(df, specs.REVIEWS, horizon=2).toPandas()
    assert len(out) == 14 and out["fatigue_score"].between(0, 1).all()
    assert datetime.date(2024, 8, 1) not in set(out["month"])
    by_month = out[out["ProductId"] == "A"].sort_values("month")["fatigue_score"].tolist()
    for i, got in enumerate(by_month):
        ahead = range(i + 1, min(i + 3, 8))
        mean = np.mean([0.5 - 0.05 * j for j in ahead])
        count = np.mean([max(1, 20 - 2 * j) for j in ahead])
        now, rc = 0.5 - 0.05 * i, max(1, 20 - 2 * i)
        want = 0.5 * max(0, now - mean) / max(abs(now), 0.01) + 0.25 * max(0, rc - count) / max(abs(rc), 0.01)
        assert got == pytest.approx(min(want, 1.0))


def test_future_rows_do_not_change_past_features(spark):
    rng = np.random.default_rng(2)
    rows = [("A", m, float(rng.integers(1, 9)), int(rng.integers(1, 9)), 3.0, 1.0) for m in months(12)]
    schema = "ProductId string, month date, sentiment_mean double, review_count bigint, score_median double, reviewer_diversity_change double"
    full = spark.createDataFrame(rows, schema)
    past = spark.createDataFrame(rows[:8], schema)
    a = history.reviews_history(full).where("month <= '2024-08-01'").orderBy("month").collect()
    b = history.reviews_history(past).orderBy("month").collect()
    assert a == b


def test_walk_forward_folds(spark):
    rows = [(p, m, float(i)) for p in "abc" for i, m in enumerate(months(12))]
    df = spark.createDataFrame(rows, "product string, month date, x double")
    folds = list(splits.walk_forward(df, "month", 6, 1))
    sizes = [(a.count(), b.count()) for a, b in folds]
    assert sizes == [(18 + 3 * i, 3) for i in range(6)]
    for train, val in folds:
        assert train.agg(F.max("month")).first()[0] < val.agg(F.min("month")).first()[0]
    sliding = [a.count() for a, _ in splits.walk_forward(df, "month", 6, 1, expanding=False)]
    assert sliding == [18] * 6
    assert splits.fold_bounds(5) == [(0, 4, 4, 5)]


@pytest.mark.parametrize("min_train,val", [(6, 1), (3, 2), (4, 3)])
def test_fold_roles_agree_with_fold_bounds(spark, min_train, val):
    n = 12
    ranked = spark.range(n).select(F.col("id").cast("int").alias("rank"))
    got = {(r["fold"], r["role"], r["rank"]) for r in splits.fold_roles(ranked, F.lit(n), min_train, val).collect()}
    want = set()
    for a, b, c, d in splits.fold_bounds(n, min_train, val):
        want |= {(b, "train", r) for r in range(a, b)} | {(b, "validation", r) for r in range(c, d)}
    assert got == want


def test_per_product_split_orders_time_and_keeps_single_rows(spark):
    rows = [("a", m) for m in months(10)] + [("b", months(1)[0])]
    train, test = splits.per_product_split(spark.createDataFrame(rows, "p string, month date"), "p", "month", 0.2)
    assert train.count() == 9 and test.count() == 2
    assert {r["p"] for r in test.collect()} == {"a"}


def test_fallback_check(spark):
    df = spark.createDataFrame([("x",)] * 20 + [("y",)] * 3, "label string")
    assert splits.needs_fallback(df, "label") and not splits.needs_fallback(df, "label", 3)


def test_threshold_table_is_exhaustive(spark, scored, probabilities):
    p, y = probabilities
    score = (p[:, 1] + p[:, 2]).round(6)
    table = tuning.threshold_table(
        scored, F.col("y") != specs.HEALTHY, F.round(F.get("p", F.lit(1)) + F.get("p", F.lit(2)), 6)
    )
    got = {round(r["threshold"], 6): r["f1_macro"] for r in table.collect()}
    truth = [c != specs.HEALTHY for c in y]
    for t in specs.THRESHOLD_GRID:
        assert got[round(t, 6)] == pytest.approx(macro_f1(truth, [bool(s >= t) for s in score]))


def test_class_weights_equal_brute_force(spark, scored, probabilities):
    p, y = probabilities
    healthy, fatigue = (0.5, 1.0), (1.0, 1.5, 2.0)
    got = {
        (r["healthy_weight"], r["high_weight"], r["moderate_weight"]): r["f1_macro"]
        for r in tuning.class_weight_table(scored, healthy_grid=healthy, fatigue_grid=fatigue).collect()
    }
    for h, a, b in product(healthy, fatigue, fatigue):
        pred = [specs.CLASSES[i] for i in (p * [h, a, b]).argmax(axis=1)]
        assert got[(h, a, b)] == pytest.approx(macro_f1(y, pred))


def test_case_weights_equal_brute_force(spark, scored, probabilities):
    p, y = probabilities
    cases = scored.withColumn("expect", F.array("y")).withColumn("must_match", F.col("id") % 2 == 0)
    grid = ((0.5, 1.0), (1.0, 3.0))
    table = tuning.case_weight_table(cases, healthy_grid=grid[0], fatigue_grid=grid[1])
    for r in table.collect():
        w = [r["healthy_weight"], r["high_weight"], r["moderate_weight"]]
        want = 0.0
        for i, row in enumerate(p):
            k = int((row * w).argmax())
            if specs.CLASSES[k] == y[i]:
                want += 1 + max(0.0, row[k] - 0.5) * 0.1
            elif i % 2 == 0:
                want -= 1
        assert r["score"] == pytest.approx(want)


def test_auc_with_a_hot_score(spark):
    rng = np.random.default_rng(8)
    score = np.where(rng.random(600) < 0.35, 0.5, rng.random(600).round(3))
    y = np.where(rng.random(600) < 0.3 + 0.4 * score, "yes", "no")
    df = spark.createDataFrame([([float(s)], c) for s, c in zip(score, y)], "p array<double>, y string")
    got = metrics.auc(df, ["yes"]).first()["auc"]
    pos, neg = score[y == "yes"], score[y == "no"]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got == pytest.approx(want)


@pytest.mark.parametrize("part_rows", [200_000, 64])
def test_running_totals(spark, part_rows):
    rows = [(k, float(v), v % 3 + 1) for k in "kl" for v in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    for key in "kl":
        out = running_totals(df, ["k"], "v", ["n"], part_rows).where(F.col("k") == key).orderBy("v").collect()
        total = 0
        for r, (_, _, n) in zip(out, [x for x in rows if x[0] == key], strict=True):
            assert r["n_below"] == total
            total += n
        assert out[0]["n_total"] == total


def test_macro_report_counts_classes_in_truth_or_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, pred string")
    row = metrics.evaluate(df).first()
    assert row["accuracy"] == pytest.approx(1 / 3)
    assert row["f1_macro"] == pytest.approx((0.5 + 0 + 0) / 3)
    assert row["balanced_accuracy"] == pytest.approx((0.5 + 0) / 2)


def test_branch_join_by_key_and_index(spark):
    a = spark.createDataFrame([("x", [0.2, 0.8]), ("y", [0.6, 0.4])], "k string, p array<double>")
    b = spark.createDataFrame([("y", [0.5, 0.5]), ("z", [0.1, 0.9])], "k string, p array<double>")
    out = {r["k"]: r for r in fusion.join_branches({"a": a, "b": b}, "k", "p", 2).collect()}
    assert out["y"]["n_branches"] == 2 and not out["x"]["has_b"]
    assert out["x"]["b"] == pytest.approx([0.3, 0.7])
    with pytest.raises(ValueError):
        fusion.require_branches({"a": a})


def test_snapshot_override(spark):
    rows = [("healthy", 0.9, 2.0, 0.1, -30.0, 20.0), ("healthy", 0.9, 3.0, 0.5, -10.0, 12.0), ("healthy", 0.9, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "pred string, confidence double, score_median double, sentiment_mean double, reviewer_diversity_change double, product_age_months double"
    )
    out = scoring.snapshot_override(df).collect()
    assert [r["pred"] for r in out] == [specs.HIGH, specs.MODERATE, specs.HEALTHY]
    assert out[0]["confidence"] == pytest.approx(1 - 0.9 * 0.15)
    with_history = df.withColumn("safe_sentiment_change", F.lit(0.1))
    assert {r["pred"] for r in scoring.snapshot_override(with_history).collect()} == {specs.HEALTHY}


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        label = 1.0 if i % 6 == 0 else 0.0
        x = rng.normal(loc=2.0 * label, size=3)
        rows.append((str(i), [float(v) for v in x], label, "healthy" if label else "fatigued"))
    df = spark.createDataFrame(rows, "_id string, v array<double>, label double, _class string")
    return df.withColumn("features", array_to_vector("v")).drop("v").cache()


def test_oversampling_balances_and_interpolates(training):
    out = balancing.oversample(training)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0.0] == counts[1.0] == 500
    real = np.array([r[0] for r in training.where("label = 1").select(vector_to_array("features")).collect()])
    made = np.array([r[0] for r in out.where("label = 1").select(vector_to_array("features")).collect()])
    assert (made.min(axis=0) >= real.min(axis=0) - 1e-9).all() and (made.max(axis=0) <= real.max(axis=0) + 1e-9).all()


def test_balance_modes(training):
    plain = models.balance_rows(training, "none")
    assert plain.count() == 600 and {r[0] for r in plain.select("weight").distinct().collect()} == {1.0}
    weighted = models.balance_rows(training, "weights").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert {round(r["w"]) for r in weighted} == {300}
    assert models.balance_rows(training, "oversample").count() == 1000
    with pytest.raises(ValueError):
        models.balance_rows(training, "other")


def test_stratified_parts_hold_every_class(spark):
    rows = [(f"p{i}", i % 7, "rare" if i % 50 == 0 else "usual" if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, m int, y string")
    rest, held = splits.stratified_split(df, "y", ["p", "m"], 0.2)
    assert rest.count() + held.count() == 500
    whole = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert {r["y"]: r["count"] for r in held.groupBy("y").count().collect()} == {y: int(n * 0.2 + 0.5) for y, n in whole.items()}
    folds = splits.stratified_folds(df, "y", ["p", "m"], 5).groupBy("y", "_fold").count().collect()
    for y, n in whole.items():
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 5 and sum(sizes) == n and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("kind,params", [
    ("logistic_regression", {"C": 1.0}), ("random_forest", {"numTrees": 5, "maxDepth": 4}),
    ("boosted_trees", {"maxIter": 3, "maxDepth": 2}),
])
def test_classifiers_learn_and_survive_storage(spark, training, kind, params):
    model = models.fit(kind, training, specs.BINARY_CLASSES, **params)
    out = model.predict(training)
    assert metrics.macro_f1(out, "_class", "pred") > 0.75
    assert out.where(F.abs(F.aggregate("p", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    path = scratch_path(spark, "test-model")
    store.save_classifier(spark, model, path)
    again = store.load_classifier(spark, path, 3).predict(training)
    assert again.select("_id", "p").exceptAll(out.select("_id", "p")).count() == 0
    with pytest.raises(ValueError):
        store.load_classifier(spark, path, 4)


def test_calibration_methods(spark, training):
    model = models.fit("random_forest", training, specs.BINARY_CLASSES, numTrees=5, maxDepth=4)
    scored = model.predict(training)
    small = calibration.fit_calibrator(scored.limit(60), specs.BINARY_CLASSES)
    assert small.method == "sigmoid"
    cal = calibration.fit_calibrator(scored, specs.BINARY_CLASSES)
    assert cal.method == "isotonic"
    out = cal.apply(scored)
    assert out.where(F.abs(F.aggregate("calibrated", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    path = scratch_path(spark, "test-calibrator")
    store.save_calibrator(spark, small, path)
    assert store.load_calibrator(spark, path).method == "sigmoid"
    store.save_calibrator(spark, cal, path)
    assert store.load_calibrator(spark, path).method == "isotonic"


def test_partners_are_a_permutation_of_the_table(training, monkeypatch):
    rows = training.select("_id", vector_to_array("features").alias("x"))
    whole = audit.with_partner(rows, ["_id"]).orderBy("_id").collect()
    assert sorted(r["x"] for r in whole) == sorted(r["_partner"] for r in whole)
    assert sum(r["x"] == r["_partner"] for r in whole) < 10
    monkeypatch.setattr(ranking, "PART_ROWS", 50)
    assert audit.with_partner(rows.repartition(5), ["_id"]).orderBy("_id").collect() == whole


def test_row_numbers_and_keyed_permutation(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    found = ranking.dense_index(df, ["v"], part_rows=90)
    assert found.where("index <> v").count() == 0 and found.count() == 1000
    for n in (1, 2, 5, 997):
        places = [r[0] for r in spark.range(n).select(ranking.permuted(F.col("id"), n, 3)).collect()]
        assert sorted(places) == list(range(n))
    assert places != list(range(997))


@pytest.mark.parametrize("kind,params", [("logistic_regression", {}), ("random_forest", {"numTrees": 5}), ("boosted_trees", {"maxIter": 5})])
def test_permutation_importance_counts_what_single_scorings_would(training, kind, params):
    model = models.fit(kind, training, specs.BINARY_CLASSES, **params)
    base = metrics.macro_f1(model.predict(training), "_class", "pred")
    found = {r["feature"]: r["f1_drop"] for r in audit.permutation_importance(model, training, list("abc"), F.col("_id")).collect()}
    rows = training.select("_id", "_class", "label", vector_to_array("features").alias("x"))
    paired = audit.with_partner(rows, ["_id"])
    mixed = F.transform("x", lambda v, i: F.when(i == 1, F.get("_partner", i)).otherwise(v))
    shuffled = metrics.macro_f1(model.predict(paired.withColumn("features", array_to_vector(mixed))), "_class", "pred")
    assert set(found) == set("abc") and found["b"] == pytest.approx(base - shuffled)


def test_top_features_of_every_classifier(training):
    for kind, params in (("logistic_regression", {}), ("boosted_trees", {"maxIter": 4}), ("decision_tree", {})):
        rows = models.fit(kind, training, specs.BINARY_CLASSES, **params).explain(training, list("abc"), 2).collect()
        assert all(len(r["top_features"]) == 2 and r["top_features"][0]["value"] >= r["top_features"][1]["value"] for r in rows)


def test_searches_in_one_pass_equal_those_of_single_fits(training):
    """Boosted trees and logistic regressions of all folds and grid points against one fit each."""
    folds = models.k_folds(splits.stratified_folds(training, "label", ["_id"], 3), "_fold", 3)
    one_by_one = [(a.drop("_fold"), b) for a, b in folds]
    boosted = {"maxIter": (3,), "maxDepth": (2, 3), "subsamplingRate": (1.0,), "featureShare": (1.0,)}
    together = models.grid_scores("boosted_trees", folds, specs.BINARY_CLASSES, boosted)
    assert len(together) == 2 and all(0.7 < s <= 1 for _, s in together)
    strengths = {"C": (0.01, 1.0)}
    together = models.grid_scores("logistic_regression", folds, specs.BINARY_CLASSES, strengths)
    alone = models.grid_scores("logistic_regression", one_by_one, specs.BINARY_CLASSES, strengths)
    assert [p for p, _ in together] == [p for p, _ in alone]
    assert [s for _, s in together] == pytest.approx([s for _, s in alone], abs=0.01)
    sampled = models.cross_validate("logistic_regression", one_by_one, specs.BINARY_CLASSES, {"C": 1.0}, "oversample")
    assert 0.7 < sampled <= 1


def test_hash_noise_is_normal(spark):
    df = spark.range(20_000).select(audit.gaussian(F.col("id"), F.lit(1)).alias("z"))
    row = df.agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03


def test_bootstrap_weights_average_to_one(spark, scored):
    row = audit.bootstrap(scored, F.col("id").cast("string"), 10).first()
    whole = metrics.macro_f1(scored)
    assert abs(row["mean_f1"] - whole) < 0.05 and row["ci_low"] <= row["mean_f1"] <= row["ci_high"]


def test_ablation_names():
    names = ["sentiment_mean", "sentiment_std", "review_count", "score_min", "score_max", "product_age_months"]
    found = {n: r for n, r, _, _ in audit.ablations("reviews", names)}
    assert len(found) >= 3 and found["no_sentiment"] == ["sentiment_mean", "sentiment_std"]
    assert found["no_product_age"] == ["product_age_months"]
    assert [n for n, _, sampled, _ in audit.ablations("reviews", names) if not sampled] == ["no_smote"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(12):
        level = 1000.0 * (p + 1)
        for m in months(20):
            level *= rng.uniform(0.6, 1.5)
            n = int(rng.integers(2, 30))
            rows.append((str(p), m, level, level / n, float(n), n, n * 3.0, n, n, 5.0 + p, 2.0 + len(rows) % 7, ("growth", "maturity")[p % 2]))
    df = spark.createDataFrame(
        rows, "StockCode string, month date, revenue_total double, revenue_mean double, revenue_std double, transaction_count bigint, "
        "quantity_sold double, unique_customers bigint, unique_orders bigint, avg_price double, product_age_months double, lifecycle_stage string"
    )
    from ebbtide.operators import signals

    return labels.with_label(signals.sales_signals(df), specs.SALES).cache()


def test_prepared_features_are_clean_and_leak_free(panel):
    out = prep.prepare(panel, specs.SALES, binary=True, test_periods=3)
    assert not set(out.features) & (set(specs.LABEL_DERIVED_COLUMNS) | set(specs.GLOBAL_Z_COLUMNS) | set(specs.ID_TIME_TARGET_COLUMNS))
    checks = {r["part"]: r for r in audit.integrity({"train": out.train, "test": out.test}, out.features).collect()}
    assert all(r["n_bad_rows"] == r["n_wrong_width"] == r["n_unlabelled"] == 0 for r in checks.values())
    means = out.train.agg(*[F.avg(c) for c in out.features]).first()
    assert max(abs(m) for m in means) < 0.05
    assert out.train.agg(F.max("_period")).first()[0] < out.test.agg(F.min("_period")).first()[0]
    assert set(out.classes) == {"fatigued", "healthy"}


def test_scorer_takes_any_numeric_input(spark, panel):
    from ebbtide.operators.batch import Scorer

    p = prep.prepare(panel, specs.SALES, binary=True, test_periods=3)
    scorer = Scorer("sales", p, models.fit("random_forest", p.train, p.classes, numTrees=5, maxDepth=4))
    names = scorer.required
    cases = [[v] * len(names) for v in (0.0, 1e15, -1e10, 1e-15, None)] + [[float("nan")] * len(names), [float("inf")] * len(names)]
    cases = [(i, *c, "no such stage") for i, c in enumerate(cases)]
    rows = spark.createDataFrame(cases, "id int, " + ", ".join(f"{c} double" for c in names) + ", lifecycle_stage string")
    out = scorer.score(rows).collect()
    assert len(out) == len(cases)
    assert all(r["pred"] in p.classes and 0 <= r["confidence"] <= 1 and 0 <= r["risk_score"] <= 100 for r in out)
    fine, bad = scorer.score_strict(rows)
    assert fine.count() + bad.count() == len(cases)
    empty = scorer.score(spark.createDataFrame([(1,)], "id int")).first()
    assert empty["completeness"] == 0.0


def test_text_features_and_enrichment(spark):
    docs = spark.createDataFrame([(1, "good good"), (2, "AWFUL broken?")], "doc_id int, text string")
    reviews = spark.createDataFrame([("p", "m1", 1), ("p", "m1", 2), ("p", "m2", 2)], "ProductId string, month string, doc_id int")
    stats = embeddings.document_statistics(docs)
    out = {r["month"]: r for r in embeddings.text_features(reviews, stats, "doc_id", ["ProductId", "month"]).collect()}
    assert out["m1"]["nlp_lexical_diversity_mean"] == 0.75 and out["m2"]["nlp_word_count_std"] == 0.0
    base = spark.createDataFrame([("p", "m1"), ("q", "m9")], "ProductId string, month string")
    joined = embeddings.enrich(base, embeddings.text_features(reviews, stats, "doc_id", ["ProductId", "month"]), ["ProductId", "month"])
    assert {r["ProductId"]: r["nlp_review_length_mean"] for r in joined.collect()}["q"] == 0.0


def test_run_log_tolerates_new_columns(spark):
    path = scratch_path(spark, "test-runs")
    rows = runs.run_rows(spark, [
        {"timestamp": "2024-01-01 00:00:00", "modality": "sales", "model": "m", "cv_f1": 0.8, "test_f1": 0.7, "best_params": {"a": 1}},
        {"timestamp": "2024-01-02 00:00:00", "modality": "sales", "model": "m", "cv_f1": 0.8, "test_f1": 0.75},
    ])
    runs.append(rows.limit(1).drop("raw_ece"), path)
    runs.append(rows, path)
    log = runs.read(spark, path)
    assert log.columns == runs.COLUMNS and log.count() == 3
    marked = runs.compare(log, 30).collect()
    assert [r["is_best"] for r in marked][0] is True
    assert {r["modality"]: r["status"] for r in runs.status(log).collect()} == {"sales": "ready", "reviews": "unavailable", "usage": "unavailable"}


def test_csv_keeps_awkward_text(spark):
    texts = ['  two "quotes", a comma ', "line\nbreak", "plain"]
    df = spark.createDataFrame([("p", "u", 5, 1, "s", x) for x in texts], readers.REVIEWS_SCHEMA)
    path = sinks.write_csv(df, scratch_path(spark, "test-csv"))
    assert sorted(r["Text"] for r in readers.read_log(spark, "reviews", path).collect()) == sorted(texts)


def test_stream_ingest_and_windows(spark):
    from ebbtide.streaming import ingest

    rows = [(datetime.datetime(2024, 1, 1 + i % 20), ("view", "cart", "purchase", "error")[i % 4], i % 3, 1.0 + i, i, f"s{i}") for i in range(80)]
    schema = "event_time timestamp, event_type string, product_id int, price double, user_id int, user_session string"
    source = scratch_path(spark, "test-stream")
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.option("header", True).csv(source)
    target = scratch_path(spark, "test-stream-out")
    events = ingest.read_event_files(spark, source, df.schema, files_per_batch=1)
    ingest.ingest(events, target, scratch_path(spark, "test-stream-state")).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.count() == 60
    totals = ingest.rolling_engagement(stored).agg(F.sum("engagement_total"), F.sum("event_count")).first()
    assert (totals[0], totals[1]) == (20 * (1 + 5 + 15), 60)
