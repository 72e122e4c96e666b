"""Training, calibration, fusion and robustness queries (checked by rows and invariants)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators import (
    audit, balancing, batch, calibration, fusion, metrics, models, newton, prep, scoring, splits, tuning,
)
from ebbtide.plans.base import Tables, query
from ebbtide.plans.shape import portable
from ebbtide.plans.summaries import union
from ebbtide.session import cut_lineage

HELD_PERIODS = 3
_KEPT: dict[tuple, object] = {}


def kept(t: Tables, name: str, make):
    """One value per session and input: queries share a prepared table or fitted model."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def sales_panel(t: Tables) -> DataFrame:
    return kept(t, "panel", lambda: cut_lineage(t.labelled("sales", "brand")))


def prepared(t: Tables, binary: bool = True) -> prep.Prepared:
    def make() -> prep.Prepared:
        out = prep.prepare(sales_panel(t), specs.SALES, binary=binary, test_periods=HELD_PERIODS)
        return prep.replace_frames(out, cut_lineage(out.train), cut_lineage(out.test))

    return kept(t, f"prepared-{binary}", make)


def folds(t: Tables, k: int = 5):
    def make() -> DataFrame:
        return cut_lineage(splits.stratified_folds(prepared(t).train, "label", ["_id", "_period"], k))

    return models.k_folds(kept(t, f"folds-{k}", make), "_fold", k)


def forest(t: Tables) -> models.Classifier:
    p = prepared(t)
    return kept(t, "forest", lambda: models.fit("random_forest", p.train, p.classes))


def scored(t: Tables) -> DataFrame:
    return forest(t).predict(prepared(t).test)


def boosted(t: Tables) -> models.Classifier:
    p = prepared(t)
    return kept(t, "boosted", lambda: models.fit("boosted_trees", p.train, p.classes))


def trained(t: Tables):
    """Every family searched over its whole grid and refitted: ({kind: classifier}, result rows)."""
    p = prepared(t)
    return kept(t, "all", lambda: models.train_all(p.train, p.test, p.classes, folds(t)))


def _cv(t: Tables, kind: str) -> DataFrame:
    rows = [(kind, str(params), score) for params, score in models.grid_scores(kind, folds(t), prepared(t).classes)]
    return portable(t.spark.createDataFrame(rows, "model string, params string, cv_f1 double"))


@query("m1_boosted_trees")
def _(t: Tables):
    return portable(metrics.evaluate(boosted(t).predict(prepared(t).test), (), "_class", "pred"))


@query("m1_boosted_trees_three_classes")
def _(t: Tables):
    p = prepared(t, binary=False)
    model = models.fit("boosted_trees", p.train, p.classes)
    return portable(metrics.per_class(metrics.confusion(model.predict(p.test), "_class", "pred")))


@query("m2_random_forest")
def _(t: Tables):
    return portable(metrics.evaluate(scored(t), (), "_class", "pred"))


@query("m3_logistic_regression")
def _(t: Tables):
    p = prepared(t)
    best, _ = models.search("logistic_regression", folds(t), p.classes)
    model = models.fit("logistic_regression", p.train, p.classes, **best)
    return portable(metrics.evaluate(model.predict(p.test), (), "_class", "pred"))


@query("m4_kmeans_by_silhouette")
def _(t: Tables):
    return portable(models.cluster(prepared(t).train)[1])


@query("m5_train_all_models")
def _(t: Tables):
    return portable(trained(t)[1])


@query("m6_grid_search")
def _(t: Tables):
    return _cv(t, "logistic_regression")


@query("m6_walk_forward_search")
def _(t: Tables):
    """Every expanding fold and every strength, trained in the same passes."""
    p = prepared(t)
    ranks, parts = splits.walk_forward_slots(p.train, "_period", min_train=6, val_periods=1)
    found = newton.search(ranks, "_slot", parts, models.GRIDS["logistic_regression"]["C"], len(p.classes))
    return portable(found)


@query("m7_shallow_tree_probe")
def _(t: Tables):
    return portable(audit.proxy_probe(prepared(t)))


@query("m8_cluster_projection")
def _(t: Tables):
    p = prepared(t)
    model, _table = kept(t, "clusters", lambda: models.cluster(p.train))
    out = models.project_clusters(model, p.train, p.test)
    return portable(out.select(F.col("_id").alias("product"), F.col("_period").alias("month"), "cluster", "pc1", "pc2"))


@query("k1_sigmoid_calibration")
def _(t: Tables):
    return _calibrated(t, "sigmoid")


@query("k2_isotonic_calibration")
def _(t: Tables):
    return _calibrated(t, "isotonic")


def _calibrated(t: Tables, method: str) -> DataFrame:
    p = prepared(t)
    rest, held = splits.stratified_split(p.train, "_class", ["_id", "_period"], 0.2)
    model = models.fit("random_forest", rest, p.classes)
    cal = calibration.fit_calibrator(model.predict(held), p.classes, method)
    out = prep.encode_label(cal.apply(model.predict(p.test)), "_class", p.classes, "y_index")
    parts = []
    for name in ("p", "calibrated"):
        row = metrics.brier(out, name)
        ece = metrics.calibration_error(out, name).select("ece").scalar()
        parts.append(row.select(F.lit(name).alias("kind"), F.lit(cal.method).alias("method"), "brier", ece.alias("ece")))
    return portable(union(parts))


@query("i9_oversampled_training_rows")
def _(t: Tables):
    p = prepared(t)
    out = balancing.oversample(p.train)
    return out.groupBy("label").agg(F.count("*").alias("n_rows"))


@query("i8_bootstrap_interval")
def _(t: Tables):
    key = F.concat_ws("|", "_id", F.col("_period").cast("string"))
    return portable(audit.bootstrap(scored(t), key, 10, "_class", "pred"))


@query("x1_out_of_fold_probabilities")
def _(t: Tables):
    return portable(out_of_fold(t, "sales").select(
        F.col("_id").alias("product"), F.col("_period").alias("month"),
        *[F.get(F.col("p"), F.lit(i)).alias(f"p_{c}") for i, c in enumerate(specs.BINARY_CLASSES)],
    ))


def branch(t: Tables, source: str) -> prep.Prepared:
    if source == "sales":
        return prepared(t)
    spec = specs.SOURCES[source]

    def make() -> prep.Prepared:
        out = prep.prepare(cut_lineage(t.labelled(source, "brand")), spec, binary=True, test_periods=HELD_PERIODS)
        return prep.replace_frames(out, cut_lineage(out.train), cut_lineage(out.test))

    return kept(t, f"branch-{source}", make)


def out_of_fold(t: Tables, source: str) -> DataFrame:
    def make() -> DataFrame:
        p = branch(t, source)
        train = cut_lineage(splits.stratified_folds(p.train, "label", ["_id", "_period"], 5))
        return cut_lineage(models.out_of_fold("random_forest", train, p.classes, F.col("_fold"), 5))

    return kept(t, f"oof-{source}", make)


def fusion_table(t: Tables) -> DataFrame:
    """Out-of-fold probabilities of both branches by brand and month, with the sales label."""
    def make() -> DataFrame:
        key = F.concat_ws("|", "_id", F.col("_period").cast("string")).alias("key")
        parts = {s: out_of_fold(t, s).select(key, "p") for s in ("reviews", "sales")}
        joined = fusion.join_branches(parts, "key", "p", 2)
        truth = out_of_fold(t, "sales").select(key, "_class", "label")
        return cut_lineage(splits.stratified_folds(joined.join(truth, "key"), "label", ["key"], 5))

    return kept(t, "fusion", make)


def fused(t: Tables) -> fusion.FusionModel:
    return kept(t, "fused", lambda: fusion.train_fusion(
        fusion_table(t), ("reviews", "sales"), specs.BINARY_CLASSES, specs.BINARY_CLASSES, "_fold", 5,
    ))


@query("x2_fusion_features")
def _(t: Tables):
    wide, names = fusion.fusion_features(fusion_table(t), ("reviews", "sales"), specs.BINARY_CLASSES)
    return portable(wide.select("key", *names, F.col("_class").alias("y")))


@query("x3_x4_x5_fusion_models")
def _(t: Tables):
    model = fused(t)
    rows = [(k, float(v), k == model.kind) for k, v in model.cv_f1.items()]
    return portable(t.spark.createDataFrame(rows, "model string, cv_f1 double, champion boolean"))


def held_out_branches(t: Tables) -> DataFrame:
    """The branches' probabilities for the held-out periods, from models fitted on the others."""
    key = F.concat_ws("|", "_id", F.col("_period").cast("string")).alias("key")
    parts = {}
    for source in ("reviews", "sales"):
        p = branch(t, source)
        model = forest(t) if source == "sales" else kept(t, f"forest-{source}", lambda p=p: models.fit("random_forest", p.train, p.classes))
        parts[source] = model.predict(p.test).select(key, "p")
    return fusion.join_branches(parts, "key", "p", 2)


@query("x8_fused_prediction")
def _(t: Tables):
    """Fused classes of the held-out periods."""
    out = fused(t).predict(held_out_branches(t))
    return portable(out.select(
        "key", "pred", "fused_probability", "confidence_band", "uncertainty_flag",
        F.col("branch_predictions")["sales"]["fatigue_class"].alias("sales_class"),
        F.col("branch_predictions")["reviews"]["fatigue_class"].alias("reviews_class"),
    ))


def scorer(t: Tables) -> batch.Scorer:
    def make() -> batch.Scorer:
        p = prepared(t)
        rest, held = splits.stratified_split(p.train, "_class", ["_id", "_period"], 0.2)
        model = models.fit("random_forest", rest, p.classes)
        on_held = cut_lineage(model.predict(held))
        cal = calibration.fit_calibrator(on_held, p.classes)
        adjusted = cal.apply(on_held)
        best = tuning.best_threshold(tuning.threshold_table(
            adjusted, F.col("_class") == specs.FATIGUED,
            F.get("calibrated", F.lit(list(p.classes).index(specs.FATIGUED))),
        )).collect()[0]
        clusters, _table = models.cluster(p.train)
        return batch.Scorer("sales", p, model, cal, clusters, float(best["threshold"]))

    return kept(t, "scorer", make)


def scoring_rows(t: Tables) -> DataFrame:
    from ebbtide.operators import history

    return history.derived_features(sales_panel(t), specs.SALES).drop("fatigue_label")


@query("x14_aligned_features")
def _(t: Tables):
    p = prepared(t)
    out = p.align(scoring_rows(t).drop("aov_change"))
    return portable(out.select("StockCode", "month", *p.features))


@query("x15_batch_prediction")
def _(t: Tables):
    out = scorer(t).score(scoring_rows(t))
    return portable(out.select(
        "StockCode", "month", "pred", "confidence", "confidence_band", "uncertainty_flag", "completeness",
        "cluster", "risk_score", "risk_band", F.size("warnings").alias("n_warnings"),
    ))


@query("x17_what_if_delta")
def _(t: Tables):
    out = scorer(t).scenario(scoring_rows(t), ["StockCode", "month"], "revenue_total", -30.0)
    return portable(out)


@query("e9_linear_contributions")
def _(t: Tables):
    p = prepared(t)
    model = models.fit("logistic_regression", p.train, p.classes, C=1.0)
    return portable(audit.linear_contributions(model, p.test, p.features))


@query("e9_path_contributions")
def _(t: Tables):
    """The five features that move each held-out row's boosted score most, along the paths of its trees."""
    p = prepared(t)
    told = boosted(t).explain(p.test, p.features)
    parts = told.select("_id", "_period", F.posexplode("top_features").alias("at", "top"))
    return portable(parts.select(
        F.col("_id").alias("product"), F.col("_period").alias("month"), (F.col("at") + 1).alias("position"), "top.feature", "top.value",
    ))


@query("x18_alerts_of_scored_rows")
def _(t: Tables):
    """Alerts of the batch scorer's rows: its warnings, completeness and top contributions."""
    out = scorer(t).score(scoring_rows(t))
    named = F.transform("top_features", lambda f: f["feature"])
    return portable(out.select(
        "StockCode", "month", F.array_join(scoring.alerts("sales", F.col("warnings"), F.col("completeness"), named), " | ").alias("alerts"),
        F.array_join(scoring.actions("sales"), " | ").alias("actions"),
    ))


@query("x21_trajectory_of_scored_rows")
def _(t: Tables):
    """The last twelve scored months of each product, their trend and the band around the score."""
    out = scoring.trajectory(scorer(t).score(scoring_rows(t)), "StockCode", "month", 12)
    return portable(out.select(
        "StockCode", "month", "risk_score", "trend_vs_last_period", "score_low", "score_high", "above_moderate_line", "above_high_line",
    ))


@query("x25_drivers_of_scored_rows")
def _(t: Tables):
    """Top contributions of each scored row by absolute size, with their width."""
    out = scorer(t).score(scoring_rows(t)).select("StockCode", "month", F.inline("top_features"))
    return portable(scoring.ranked_drivers(out, ["StockCode", "month"], "feature", "value"))


@query("t4_top_features")
def _(t: Tables):
    rows = forest(t).importances(prepared(t).features)[:20]
    table = t.spark.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(rows)], "position int, feature string, importance double")
    return portable(table)


@query("e10_permutation_importance")
def _(t: Tables):
    p = prepared(t)
    key = F.concat_ws("|", "_id", F.col("_period").cast("string"))
    return portable(audit.permutation_importance(forest(t), p.test, p.features, key))


@query("r1_integrity_audit")
def _(t: Tables):
    p = prepared(t)
    return audit.integrity({"train": p.train, "test": p.test}, p.features)


@query("r2_leakage_audit")
def _(t: Tables):
    p = prepared(t)
    found = audit.leaked_columns(p.features)
    panel = audit.leaked_columns(sales_panel(t).columns)
    n = p.train.agg(F.count("*")).scalar()
    rows = [(k, len(panel[k]), len(found[k])) for k in found]
    return portable(t.spark.createDataFrame(rows, "kind string, in_panel int, in_features int").withColumn("n_rows", n))


@query("r3_redundancy_audit")
def _(t: Tables):
    from ebbtide.operators.summaries import correlations

    p = prepared(t)
    flat = audit.near_constant(p.train, p.features).select(
        F.lit("near_constant").alias("kind"), F.col("column").alias("a"), F.lit(None).cast("string").alias("b"), F.col("std").alias("value")
    )
    pairs = correlations(p.train, p.features).select(F.lit("correlation").alias("kind"), "a", "b", F.col("r").alias("value"))
    return portable(flat.unionByName(pairs))


@query("r5_noise_flip_rate")
def _(t: Tables):
    p = prepared(t)
    key = F.concat_ws("|", "_id", F.col("_period").cast("string"))
    return portable(audit.noise_flips(forest(t), p.test, key))


@query("r7_perturbation_sensitivity")
def _(t: Tables):
    s = scorer(t)
    rows = scoring_rows(t)
    names = [c for c in s.required if c in rows.columns]
    key = F.concat_ws("|", "StockCode", F.col("month").cast("string"))
    return portable(audit.perturbation_sensitivity(lambda df: s.score(df, explained=False), rows, names, key))


@query("r10_ablation_definitions")
def _(t: Tables):
    p = prepared(t)
    counts = p.train.agg(F.count("*")).scalar()
    rows = [(n, len(r), b, c) for n, r, b, c in audit.ablations("sales", p.features)]
    out = t.spark.createDataFrame(rows, "experiment string, n_removed int, balanced boolean, calibrated boolean")
    return portable(out.withColumn("n_train", counts))


@query("r11_ablation_run")
def _(t: Tables):
    return portable(audit.run_ablations(prepared(t), "sales", "logistic_regression", C=1.0))


@query("r8_audit_verdict")
def _(t: Tables):
    p = prepared(t)
    table = trained(t)[1]
    probe = audit.proxy_probe(p).select(
        F.when(F.col("verdict") == "FAIL", "HIGH").when(F.col("verdict") == "WARN", "MEDIUM").otherwise("LOW").alias("severity"),
        F.lit("leakage").alias("component"),
    )
    key = F.concat_ws("|", "_id", F.col("_period").cast("string"))
    stability = audit.bootstrap(scored(t), key, 10, "_class", "pred").select("stability").scalar()
    return portable(audit.verdict(probe, metrics.performance_status(table), stability))


@query("c10_forward_labelled_features")
def _(t: Tables):
    panel = kept(t, "panel", lambda: cut_lineage(t.labelled("sales", "brand")))
    out = prep.prepare(panel, specs.SALES, forward=True, horizon=2, test_periods=3)
    return portable(out.artifacts())

