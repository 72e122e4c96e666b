"""Metrics, tuning, decision policy, fusion and scoring read models.

The probabilities are derived from the labelled panels by hashing row keys, so that every operator
here is checked exactly and without a model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import probability as P
from ebbtide.functions import scalars as S
from ebbtide.operators import metrics, scoring, tuning, validation
from ebbtide.plans.base import Tables, fragment, query, r6, sql_bucket
from ebbtide.plans.shape import portable, rounded
from ebbtide.plans.summaries import SOURCE_NAMES, union

ROW_ID = {s: specs.SOURCES[s].id_col for s in SOURCE_NAMES}


def with_probabilities(df: DataFrame, source: str, out: str = "p", salt: str = "") -> DataFrame:
    """Pseudo-probabilities that lean towards the row's label."""
    key = F.concat_ws(
        "|", F.col(ROW_ID[source]).cast("string"), F.date_format("month", "yyyy-MM-dd")
    )
    raw = [
        S.hash_bucket(F.concat(key, F.lit(f"#{salt}{i}"))) / 1_000_000.0
        + F.when(F.col("fatigue_label") == c, 0.5).otherwise(0.0)
        for i, c in enumerate(specs.CLASSES)
    ]
    return (
        df.withColumn("_raw", F.array(*raw))
        .withColumn("_sum", F.get("_raw", F.lit(0)) + F.get("_raw", F.lit(1)) + F.get("_raw", F.lit(2)))
        .withColumn(out, F.array(*[rounded(F.get("_raw", F.lit(i)) / F.col("_sum")) for i in range(3)]))
        .drop("_raw", "_sum")
    )


def scored(t: Tables, source: str, grain: str = "part") -> DataFrame:
    df = with_probabilities(t.labelled(source, grain), source)
    codes = F.array(*[F.lit(c) for c in specs.CLASSES])
    return df.withColumns({
        "product": F.col(ROW_ID[source]).cast("string"),
        "y": F.col("fatigue_label"),
        "y_index": (F.array_position(codes, F.col("fatigue_label")) - 1).cast("int"),
        "pred": P.class_at(P.arg_max(F.col("p")), specs.CLASSES),
        "confidence": P.top_probability(F.col("p")),
    })


def prob(i: int, name: str = "p") -> Column:
    return F.get(F.col(name), F.lit(i))


def _probabilities_sql(idc: str, salt: str = "") -> str:
    key = f"\"{idc}\"::VARCHAR || '|' || strftime(month, '%Y-%m-%d')"
    raws = [
        f"({sql_bucket(f'{key} || {chr(39)}#{salt}{i}{chr(39)}')} / 1000000.0::DOUBLE "
        f"+ CASE WHEN fatigue_label = '{c}' THEN 0.5 ELSE 0.0 END::DOUBLE)"
        for i, c in enumerate(specs.CLASSES)
    ]
    return ", ".join(f"{r} AS raw{salt}{i}" for i, r in enumerate(raws))


def _argmax_sql(a: str, b: str, c: str) -> str:
    return (f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 'healthy' WHEN {b} >= {c} THEN 'high_fatigue' "
            "ELSE 'moderate_fatigue' END")


def _scored_fragments(source: str, frag: str, name: str) -> None:
    idc = ROW_ID[source]
    total, total_c = "(raw0 + raw1 + raw2)", "(rawc0 + rawc1 + rawc2)"
    ps = ", ".join(f"{r6(f'raw{i} / {total}')} AS p{i}" for i in range(3))
    qs = ", ".join(f"{r6(f'rawc{i} / {total_c}')} AS q{i}" for i in range(3))
    fragment(f"{name}_probs", f"""
SELECT *, {ps}, {qs}
FROM (SELECT *, {_probabilities_sql(idc)}, {_probabilities_sql(idc, 'c')} FROM {frag})""")
    fragment(name, f"""
SELECT *, "{idc}"::VARCHAR AS product, fatigue_label AS y, {_argmax_sql('p0', 'p1', 'p2')} AS pred,
  greatest(p0, p1, p2) AS confidence,
  p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2) AS middle,
  CASE fatigue_label WHEN 'healthy' THEN 0 WHEN 'high_fatigue' THEN 1 ELSE 2 END AS y_index
FROM {name}_probs""")


for _s in SOURCE_NAMES:
    _scored_fragments(_s, f"{_s}_panel", f"{_s}_scored")
_scored_fragments("sales", "brand_sales_panel", "brand_sales_scored")
_scored_fragments("reviews", "brand_reviews_panel", "brand_reviews_scored")
_KEY = "product, strftime(month, '%Y-%m-%d') AS month"


def keyed(df: DataFrame, *cols) -> DataFrame:
    return portable(df.select("product", "month", *cols))


# ----------------------------------------------------------------- E1..E8


@query("e1_confusion_matrix", "SELECT y, pred, count(*) AS n FROM sales_scored GROUP BY ALL")
def _(t: Tables):
    return metrics.confusion(scored(t, "sales"))


def class_fragments(name: str, by: str = "") -> None:
    """Per-class counts of a scored fragment, optionally within a group column."""
    group = f"{by}, " if by else ""
    fragment(f"{name}_classes", f"""
SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support
FROM (SELECT {group}class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
  SELECT {group}y AS class, (y = pred)::INT AS tp, 0 AS fp, (y <> pred)::INT AS fn FROM {name}
  UNION ALL SELECT {group}pred, 0, (y <> pred)::INT, 0 FROM {name}) GROUP BY ALL)""")
    fragment(f"{name}_report", f"""
SELECT {group}sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(precision) AS precision_macro,
  avg(recall) AS recall_macro, avg(f1) AS f1_macro, avg(recall) FILTER (support > 0) AS balanced_accuracy,
  sum(abs((tp + fn) - (tp + fp)))::DOUBLE / sum(support) / 2 AS drift
FROM {name}_classes {f'GROUP BY {by}' if by else ''}""")


for _s in SOURCE_NAMES:
    class_fragments(f"{_s}_scored")
class_fragments("brand_sales_scored")
_REPORT = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy")
_REPORT_SQL = "n, " + ", ".join(f"{r6(c)} AS {c}" for c in _REPORT)


@query("e2_classification_report", f"SELECT {_REPORT_SQL} FROM sales_scored_report")
def _(t: Tables):
    return portable(metrics.evaluate(scored(t, "sales")))


@query("e2b_class_recalls", f"SELECT class, support, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM sales_scored_classes")
def _(t: Tables):
    out = metrics.per_class(metrics.confusion(scored(t, "sales")))
    return portable(out, ["class", "support", "precision", "recall", "f1"])


_OVR = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS class, p{i} AS score, (y = '{c}')::INT AS pos FROM {{f}}" for i, c in enumerate(specs.CLASSES)
)
fragment("sales_ovr", _OVR.format(f="sales_scored"))


@query("e3_auc_per_class", f"""
SELECT class, {r6('(sum(rank) FILTER (pos = 1) - n_pos * (n_pos + 1) / 2) / (n_pos * (n_all - n_pos))')} AS auc FROM (
  SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score)
     + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS rank,
    sum(pos) OVER (PARTITION BY class)::DOUBLE AS n_pos, count(*) OVER (PARTITION BY class)::DOUBLE AS n_all FROM sales_ovr)
GROUP BY class, n_pos, n_all""")
def _(t: Tables):
    return portable(metrics.auc(scored(t, "sales"), specs.CLASSES))


@query("e3_roc_curve", f"""
SELECT class, {r6('score')} AS threshold, {r6('sum(pos) OVER w / nullif(sum(pos) OVER c, 0)')} AS tpr,
  {r6('sum(neg) OVER w / nullif(sum(neg) OVER c, 0)')} AS fpr
FROM (SELECT class, score, sum(pos)::DOUBLE AS pos, sum(1 - pos)::DOUBLE AS neg FROM sales_ovr GROUP BY ALL)
WINDOW w AS (PARTITION BY class ORDER BY score DESC), c AS (PARTITION BY class)""")
def _(t: Tables):
    return portable(metrics.roc_curve(scored(t, "sales"), specs.CLASSES))


_BRIER = "avg((p0 - (y_index = 0)::INT)^2 + (p1 - (y_index = 1)::INT)^2 + (p2 - (y_index = 2)::INT)^2)"


@query("e4_brier_score", f"SELECT {r6(_BRIER)} AS brier FROM sales_scored")
def _(t: Tables):
    return portable(metrics.brier(scored(t, "sales")))


def _bin_sql(c: str) -> str:
    return " + ".join(f"({c} >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))


for _s in ("sales", "reviews", "usage"):
    fragment(f"{_s}_bins", f"""
SELECT {_bin_sql('confidence')} AS bin, avg(confidence) AS mean_predicted, avg((y = pred)::INT) AS fraction_correct,
  count(*) AS n_rows FROM {_s}_scored GROUP BY 1""")


@query("e5_calibration_error", f"SELECT {r6('sum(abs(fraction_correct - mean_predicted) * n_rows) / sum(n_rows)')} AS ece FROM sales_bins")
def _(t: Tables):
    return portable(metrics.calibration_error(scored(t, "sales")))


@query("k8_reliability_table", f"""
SELECT g.b::BIGINT AS bin, {r6('g.b / 10.0')} AS low, {r6('(g.b + 1) / 10.0')} AS high, {r6('mean_predicted')} AS mean_predicted,
  {r6('fraction_correct')} AS fraction_correct, coalesce(n_rows, 0) AS n_rows
FROM (SELECT unnest(generate_series(0, 9)) AS b) g LEFT JOIN sales_bins ON bin = g.b""")
def _(t: Tables):
    return portable(metrics.reliability(scored(t, "sales")))


@query("e6_distribution_drift", f"SELECT {r6('drift')} AS drift FROM sales_scored_report")
def _(t: Tables):
    return portable(metrics.distribution_drift(metrics.confusion(scored(t, "sales"))))


_LATE = "month > (SELECT max(month) FROM sales_scored) - INTERVAL 12 MONTH"
fragment("early_scored", f"SELECT * FROM sales_scored WHERE NOT ({_LATE})")
class_fragments("early_scored", "lifecycle_stage")
fragment("late_scored", f"SELECT * FROM sales_scored WHERE {_LATE}")
class_fragments("late_scored", "lifecycle_stage")


def early_and_late(t: Tables) -> DataFrame:
    """Metrics of each stage in its last twelve months, with the macro F1 of the months before as ``cv_f1``."""
    df = scored(t, "sales")
    late = F.col("month") > F.add_months(df.agg(F.max("month")).scalar(), -12)
    before = metrics.evaluate(df.where(~late), ["lifecycle_stage"])
    return metrics.evaluate(df.where(late), ["lifecycle_stage"]).join(
        before.select("lifecycle_stage", F.col("f1_macro").alias("cv_f1")), "lifecycle_stage"
    )


@query("e7_gap_and_leakage_flag", f"""
SELECT lifecycle_stage, {r6('e.f1_macro - l.f1_macro')} AS cv_test_gap, l.accuracy > 0.98 AS leakage_flag
FROM late_scored_report l JOIN early_scored_report e USING (lifecycle_stage)""")
def _(t: Tables):
    table = metrics.gap_and_leakage(early_and_late(t))
    return portable(table, ["lifecycle_stage", "cv_test_gap", "leakage_flag"])


fragment("stage_scored", "SELECT * FROM sales_scored")
class_fragments("stage_scored", "lifecycle_stage")


@query("e8_metric_summary", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS source, {_REPORT_SQL}, {r6('drift')} AS drift FROM {s}_scored_report" for s in SOURCE_NAMES
))
def _(t: Tables):
    parts = []
    for s in SOURCE_NAMES:
        conf = metrics.confusion(scored(t, s).withColumn("source", F.lit(s)), by=["source"])
        parts.append(metrics.report(conf, ["source"]).join(metrics.distribution_drift(conf, ["source"]), "source"))
    return portable(union(parts))


@query("e11_required_completeness", f"""
SELECT product_id::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month, {r6('share')} AS completeness, share = 1.0 AS accepted
FROM (SELECT *, ((engagement_velocity IS NOT NULL)::INT + (view_to_cart_rate IS NOT NULL)::INT
  + (cart_to_purchase_rate IS NOT NULL)::INT + (engagement_total IS NOT NULL)::INT) / 4.0::DOUBLE AS share FROM usage_signals)""")
def _(t: Tables):
    required = ["engagement_velocity", "view_to_cart_rate", "cart_to_purchase_rate", "engagement_total"]
    good, bad = validation.strict_split(t.usage(), required)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return portable(both.select(F.col("product_id").cast("string").alias("product"), "month", "completeness", "accepted"))


_USED = ("engagement_total", "view_count", "cart_count", "purchase_count", "conversion_rate")


@query("e12_non_zero_completeness", "SELECT product_id::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month, "
       + r6("round((" + " + ".join(f"coalesce((abs({c}) > 1e-9)::INT, 0)" for c in _USED) + ")::DOUBLE / ("
            + " + ".join(f"({c} IS NOT NULL)::INT" for c in _USED) + "), 3)") + " AS completeness FROM usage_signals")
def _(t: Tables):
    df = t.usage().withColumn("completeness", validation.non_zero_completeness(_USED))
    return portable(df.select(F.col("product_id").cast("string").alias("product"), "month", "completeness"))


# ----------------------------------------------------------------- K3..K9


fragment("threshold_steps", "SELECT unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in specs.THRESHOLD_GRID) + "]) AS threshold")
fragment("binary_scored", f"SELECT *, {r6('p1 + p2')} AS p_fatigued, y <> 'healthy' AS positive FROM sales_scored")
fragment("threshold_table", """
SELECT threshold, tp, fp, fn, tn, (coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)
   + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro
FROM (SELECT threshold, count(*) FILTER (positive AND p_fatigued >= threshold) AS tp,
  count(*) FILTER (NOT positive AND p_fatigued >= threshold) AS fp, count(*) FILTER (positive AND p_fatigued < threshold) AS fn,
  count(*) FILTER (NOT positive AND p_fatigued < threshold) AS tn FROM binary_scored, threshold_steps GROUP BY threshold)""")


def _thresholds(t: Tables) -> DataFrame:
    df = scored(t, "sales")
    return tuning.threshold_table(df, F.col("y") != specs.HEALTHY, rounded(prob(1) + prob(2)))


@query("k3_threshold_table", f"SELECT {r6('threshold')} AS threshold, tp, fp, fn, tn, {r6('f1_macro')} AS f1_macro FROM threshold_table")
def _(t: Tables):
    return portable(_thresholds(t))


@query("k3_best_threshold", f"""
SELECT {r6('threshold')} AS threshold, {r6('f1_macro')} AS f1_macro FROM threshold_table
ORDER BY round(f1_macro, 12) DESC, threshold LIMIT 1""")
def _(t: Tables):
    return portable(tuning.best_threshold(_thresholds(t)).select("threshold", "f1_macro"))


def _grid_sql(healthy, fatigue) -> str:
    def values(xs):
        return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + "]"

    n = len(fatigue)
    return f"""SELECT h.i * {n * n} + a.i * {n} + b.i AS candidate, h.w AS wh, a.w AS wa, b.w AS wb FROM
  (SELECT unnest({values(healthy)}) AS w, unnest(generate_series(0, {len(healthy) - 1})) AS i) h,
  (SELECT unnest({values(fatigue)}) AS w, unnest(generate_series(0, {n - 1})) AS i) a,
  (SELECT unnest({values(fatigue)}) AS w, unnest(generate_series(0, {n - 1})) AS i) b"""


fragment("weight_grid", _grid_sql(specs.HEALTHY_WEIGHT_GRID, specs.FATIGUE_WEIGHT_GRID))
fragment("case_grid", _grid_sql(specs.CASE_HEALTHY_WEIGHT_GRID, specs.CASE_FATIGUE_WEIGHT_GRID))
fragment("weighted", f"""
SELECT candidate, wh, wa, wb, y, {_argmax_sql('p0 * wh', 'p1 * wa', 'p2 * wb')} AS pred FROM brand_sales_scored, weight_grid""")
class_fragments("weighted", "candidate, wh, wa, wb")


@query("k4_class_weight_table", f"""
SELECT candidate::BIGINT AS candidate, wh AS healthy_weight, wa AS high_weight, wb AS moderate_weight, {r6('f1_macro')} AS f1_macro
FROM weighted_report""")
def _(t: Tables):
    return portable(tuning.class_weight_table(scored(t, "sales", "brand")))


@query("k4_best_class_weights", f"""
SELECT candidate::BIGINT AS candidate, wh AS healthy_weight, wa AS high_weight, wb AS moderate_weight, {r6('f1_macro')} AS f1_macro
FROM weighted_report ORDER BY round(f1_macro, 12) DESC, (wh = 1 AND wa = 1 AND wb = 1) DESC, candidate LIMIT 1""")
def _(t: Tables):
    return portable(tuning.best_class_weights(tuning.class_weight_table(scored(t, "sales", "brand"))))


def acceptance_cases(df: DataFrame) -> DataFrame:
    """Every scored row as a case: a fatigued row may be answered by either fatigue class."""
    both = F.array(F.lit(specs.MODERATE), F.lit(specs.HIGH))
    return df.withColumns({
        "expect": F.when(F.col("y") == specs.HEALTHY, F.array(F.lit(specs.HEALTHY))).otherwise(both),
        "must_match": F.col("lifecycle_stage") != "decline",
    })


_CASE_SCORE = """CASE WHEN (y = 'healthy') = (pred = 'healthy') THEN 1.0::DOUBLE + greatest(conf - 0.5, 0) * 0.1::DOUBLE
  WHEN lifecycle_stage <> 'decline' THEN -1.0 ELSE 0.0 END"""


@query("k5_case_weight_table", f"""
SELECT candidate::BIGINT AS candidate, wh AS healthy_weight, wa AS high_weight, wb AS moderate_weight, {r6(f'sum({_CASE_SCORE})')} AS score
FROM (SELECT *, CASE pred WHEN 'healthy' THEN p0 WHEN 'high_fatigue' THEN p1 ELSE p2 END AS conf
  FROM (SELECT * EXCLUDE (pred), {_argmax_sql('p0 * wh', 'p1 * wa', 'p2 * wb')} AS pred FROM brand_sales_scored, case_grid)) GROUP BY ALL""")
def _(t: Tables):
    return portable(tuning.case_weight_table(acceptance_cases(scored(t, "sales", "brand"))))


@query("j9_acceptance_cases", f"""
SELECT {_KEY}, pred, (y = 'healthy') = (pred = 'healthy') AS matched, {r6(_CASE_SCORE)} AS score
FROM (SELECT *, confidence AS conf FROM sales_scored)""")
def _(t: Tables):
    df = acceptance_cases(scored(t, "sales"))
    score = tuning.case_score(F.col("pred"), F.col("confidence"), F.col("expect"), F.col("must_match"))
    return keyed(df, "pred", F.array_contains("expect", F.col("pred")).alias("matched"), score.alias("score"))


_MODELS = ("p", "q")


@query("r13_acceptance_scores", f"""
SELECT model, {r6('score', 4)} AS score, score = max(score) OVER () AS best FROM (
  SELECT 'p' AS model, sum({_CASE_SCORE}) AS score FROM (SELECT *, confidence AS conf FROM sales_scored)
  UNION ALL SELECT 'q', sum({_CASE_SCORE}) FROM (SELECT * EXCLUDE (pred), greatest(q0, q1, q2) AS conf,
    {_argmax_sql('q0', 'q1', 'q2')} AS pred FROM sales_scored))""")
def _(t: Tables):
    cases = acceptance_cases(with_probabilities(scored(t, "sales"), "sales", "q", "c"))
    items = F.array(*[
        F.struct(F.lit(m).alias("model"), tuning.case_score(
            P.class_at(P.arg_max(F.col(m)), specs.CLASSES), P.top_probability(F.col(m)),
            F.col("expect"), F.col("must_match")).alias("score"))
        for m in _MODELS
    ])
    table = cases.select(F.inline(items)).groupBy("model").agg(F.sum("score").alias("score"))
    best = table.agg(F.max("score")).scalar()
    return portable(table.withColumn("best", F.col("score") == best), digits=4)


@query("t6_champion_by_score", f"""
SELECT max_by(source, f1_macro) AS champion, {r6('max(f1_macro)')} AS f1_macro FROM (
  {' UNION ALL '.join(f"SELECT '{s}' AS source, f1_macro FROM {s}_scored_report" for s in SOURCE_NAMES)})""")
def _(t: Tables):
    table = union(
        metrics.evaluate(scored(t, s).withColumn("source", F.lit(s)), ["source"]) for s in SOURCE_NAMES
    )
    return portable(table.agg(F.max_by("source", "f1_macro").alias("champion"), F.max("f1_macro").alias("f1_macro")))


@query("k6_decision_policy", f"""
SELECT {_KEY}, {_argmax_sql('p0 * 0.8::DOUBLE', 'p1 * 1.5::DOUBLE', 'p2 * 1.25::DOUBLE')} AS weighted_class,
  CASE WHEN {r6('p1 + p2')} >= 0.6 THEN 'fatigued' ELSE 'healthy' END AS binary_class FROM sales_scored""")
def _(t: Tables):
    weights = {specs.HEALTHY: 0.8, specs.HIGH: 1.5, specs.MODERATE: 1.25}
    two = F.array(rounded(prob(1) + prob(2)), prob(0))
    return keyed(
        scored(t, "sales"), P.decide(F.col("p"), specs.CLASSES, weights).alias("weighted_class"),
        P.decide(two, specs.BINARY_CLASSES, threshold=0.6).alias("binary_class"),
    )


_BAND = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"
fragment("sales_margins", """
SELECT *, list_sort([p0, p1, p2])[3] - list_sort([p0, p1, p2])[2] AS margin FROM sales_scored""")


@query("k7_uncertainty_flags", f"""
SELECT {_KEY}, {r6('confidence')} AS max_probability, {r6('margin')} AS margin, {_BAND} AS confidence_band,
  confidence < 0.6 OR margin < 0.15 AS uncertainty_flag FROM sales_margins""")
def _(t: Tables):
    return keyed(
        scoring.uncertainty(scored(t, "sales")), "max_probability", "margin", "confidence_band", "uncertainty_flag"
    )


@query("k9_raw_and_calibrated", f"""
SELECT {_KEY}, pred AS raw_class, {_argmax_sql('q0', 'q1', 'q2')} AS calibrated_class,
  {r6('greatest(q0, q1, q2) - confidence')} AS adjustment, pred <> {_argmax_sql('q0', 'q1', 'q2')} AS prediction_changed,
  (pred <> {_argmax_sql('q0', 'q1', 'q2')})::INT::BIGINT + (greatest(q0, q1, q2) > 0.97)::INT::BIGINT AS n_warnings
FROM sales_scored""")
def _(t: Tables):
    df = with_probabilities(scored(t, "sales"), "sales", "q", "c")
    out = scoring.compare_calibration(df, "p", "q")
    return keyed(out, "raw_class", "calibrated_class", "adjustment", "prediction_changed", F.size("warnings").alias("n_warnings"))


@query("r6_confidence_distribution", f"""
SELECT {r6('avg(confidence)')} AS mean_confidence, {r6('stddev_pop(confidence)')} AS std_confidence,
  count(*) FILTER (confidence > 0.97) AS n_overconfident, {r6('avg((confidence > 0.97)::INT) * 100')} AS overconfident_percent,
  {r6('quantile_cont(confidence, 0.5)')} AS median_confidence FROM sales_scored""")
def _(t: Tables):
    from ebbtide.operators.quantiles import quantile_values

    df = scored(t, "sales")
    median = quantile_values(df, [("confidence", 0.5)], hold=True)[("confidence", 0.5)]
    return portable(metrics.confidence_summary(df).withColumn("median_confidence", F.lit(median)))


# ----------------------------------------------------------------- R9, R12


@query("r9_performance_status", """
SELECT lifecycle_stage, CASE WHEN l.f1_macro >= 0.95 THEN 'SUSPICIOUS' WHEN abs(e.f1_macro - l.f1_macro) >= 0.05 THEN 'GAP_TOO_LARGE'
  WHEN l.f1_macro < 0.65 OR l.f1_macro > 0.92 THEN 'OUT_OF_RANGE' ELSE 'PASS' END AS status
FROM late_scored_report l JOIN early_scored_report e USING (lifecycle_stage)""")
def _(t: Tables):
    table = early_and_late(t).select(
        "lifecycle_stage", F.col("f1_macro").alias("test_f1"), (F.col("cv_f1") - F.col("f1_macro")).alias("cv_test_gap")
    )
    return metrics.performance_status(table).select("lifecycle_stage", "status")


fragment("age_scored", """
SELECT *, CASE WHEN product_age_months <= lo THEN 'age_young' WHEN product_age_months <= hi THEN 'age_mid_age' ELSE 'age_old' END AS subgroup
FROM sales_scored, (SELECT quantile_cont(product_age_months, 0.33) AS lo, quantile_cont(product_age_months, 0.66) AS hi FROM sales_scored)""")
fragment("group_scored", """
SELECT y, pred, subgroup FROM age_scored UNION ALL SELECT y, pred, 'lifecycle_' || lifecycle_stage FROM sales_scored""")
class_fragments("group_scored", "subgroup")


@query("r12_subgroup_metrics", f"""
SELECT subgroup, n, {r6('f1_macro')} AS f1_macro, {r6('recall_macro')} AS recall_macro FROM group_scored_report WHERE n >= 10""")
def _(t: Tables):
    from ebbtide.operators.audit import subgroup_metrics

    return portable(subgroup_metrics(scored(t, "sales")), ["subgroup", "n", "f1_macro", "recall_macro"])


# ----------------------------------------------------------------- X6..X13, X16, X18, X21, X24, X25, W12, W15

_LATEST = "SELECT product, arg_max(p0, month) AS p0, arg_max(p1, month) AS p1, arg_max(p2, month) AS p2, max(month) AS month FROM {s}_scored GROUP BY product"
for _s in SOURCE_NAMES:
    fragment(f"{_s}_latest", _LATEST.format(s=_s))


def branch_table(t: Tables) -> DataFrame:
    from ebbtide.operators.fusion import join_branches

    latest = {
        s: scoring.latest_rows(scored(t, s), "product", "month", ["p"]).select("product", "p") for s in SOURCE_NAMES
    }
    return join_branches(latest, "product", "p", len(specs.CLASSES))


@query("w12_latest_row_per_product", f"SELECT product, strftime(month, '%Y-%m-%d') AS month, {r6('p0')} AS p_healthy FROM sales_latest")
def _(t: Tables):
    df = scoring.latest_rows(scored(t, "sales"), "product", "month", ["p"])
    return portable(df.select("product", "month", prob(0).alias("p_healthy")))


_PRIORS = ", ".join(
    f"(SELECT avg(p{i}) FROM {s}_latest) AS {s}_prior{i}" for s in SOURCE_NAMES for i in range(3)
)
fragment("branches", "SELECT product, " + ", ".join(
    f"{s}_latest.p0 IS NOT NULL AS has_{s}, " + ", ".join(
        f"coalesce({s}_latest.p{i}, (SELECT avg(p{i}) FROM {s}_latest)) AS {s}_p{i}" for i in range(3)
    ) for s in SOURCE_NAMES
) + """ FROM reviews_latest FULL JOIN sales_latest USING (product) FULL JOIN usage_latest USING (product)""")


@query("j6_branch_assembly", "SELECT product, " + ", ".join(
    f"has_{s}, " + ", ".join(f"{r6(f'{s}_p{i}')} AS {s}_{c}" for i, c in enumerate(specs.CLASSES)) for s in SOURCE_NAMES
) + " FROM branches")
def _(t: Tables):
    table = branch_table(t)
    cols = []
    for s in SOURCE_NAMES:
        cols.append(F.col(f"has_{s}"))
        cols += [F.get(F.col(s), F.lit(i)).alias(f"{s}_{c}") for i, c in enumerate(specs.CLASSES)]
    return portable(table.select("product", *cols))


@query("x6_fatigue_index", f"""
SELECT product, {r6('least(greatest(0.3::DOUBLE * reviews_p1 + 0.3::DOUBLE * sales_p1 + 0.4::DOUBLE * usage_p1, 0), 1)')} AS fatigue_index
FROM branches""")
def _(t: Tables):
    index = scoring.fatigue_index({s: prob(1, s) for s in SOURCE_NAMES})
    return portable(branch_table(t).select("product", index.alias("fatigue_index")))


@query("x7_branch_count_guard", """
SELECT (has_reviews::INT + has_sales::INT + has_usage::INT)::BIGINT AS n_branches, has_reviews::INT + has_sales::INT + has_usage::INT >= 2 AS fusable,
  count(*) AS n_products FROM branches GROUP BY ALL""")
def _(t: Tables):
    df = branch_table(t).select(F.col("n_branches").cast("bigint"), (F.col("n_branches") >= 2).alias("fusable"))
    return df.groupBy("n_branches", "fusable").agg(F.count("*").alias("n_products"))


@query("x9_recommended_action", f"""
SELECT {_KEY}, CASE WHEN pred = 'high_fatigue' AND NOT unsure THEN 'urgent intervention' WHEN pred = 'moderate_fatigue' THEN 'proactive monitoring'
  WHEN unsure THEN 'manual review needed' ELSE 'monitor' END AS action
FROM (SELECT *, confidence < 0.6 OR margin < 0.15 AS unsure FROM sales_margins)""")
def _(t: Tables):
    df = scored(t, "sales")
    return keyed(df, scoring.recommended_action(F.col("pred"), P.needs_review(F.col("p"))).alias("action"))


@query("x10_driver_summary", f"""
SELECT product, coalesce(nullif(concat_ws('; ', CASE WHEN usage_p1 > 0.5 THEN '{scoring.DRIVER_USAGE}' END,
  CASE WHEN reviews_p1 > 0.3 OR reviews_p2 > 0.5 THEN '{scoring.DRIVER_REVIEWS}' END,
  CASE WHEN sales_p1 > 0.3 OR sales_p2 > 0.5 THEN '{scoring.DRIVER_SALES}' END), ''), '{scoring.DRIVER_NONE}') AS drivers
FROM branches""")
def _(t: Tables):
    drivers = scoring.driver_summary(
        prob(1, "usage"), prob(1, "reviews"), prob(2, "reviews"), prob(1, "sales"), prob(2, "sales")
    )
    return branch_table(t).select("product", drivers.alias("drivers"))


_RISK = ("least(greatest(CASE pred WHEN 'high_fatigue' THEN 72 + confidence * 28 WHEN 'moderate_fatigue' THEN 45 + confidence * 24 "
         "ELSE 10 + (1 - confidence) * 18 END, 0), 100)")
for _s in SOURCE_NAMES:
    fragment(f"{_s}_risk", f"SELECT *, round(({_RISK})::DOUBLE::VARCHAR::DECIMAL(38,20), 2)::DOUBLE AS risk_score FROM {_s}_scored")


@query("x11_risk_score", f"SELECT {_KEY}, risk_score FROM sales_risk")
def _(t: Tables):
    return keyed(scoring.risk(scored(t, "sales")), "risk_score")


@query("x12_risk_band", """
SELECT CASE WHEN risk_score >= 70 THEN 'High Fatigue' WHEN risk_score >= 40 THEN 'Moderate Fatigue' ELSE 'Healthy' END AS risk_band,
  count(*) AS n_rows FROM sales_risk GROUP BY ALL""")
def _(t: Tables):
    return scoring.risk(scored(t, "sales")).groupBy("risk_band").agg(F.count("*").alias("n_rows"))


_SEVERE = "score_median <= 2.5 AND sentiment_mean <= 0.25 AND coalesce(reviewer_diversity_change, 0) <= -20 AND product_age_months >= 18"
_DRIFT = "score_median <= 3.2 AND sentiment_mean <= 0.6 AND coalesce(reviewer_diversity_change, 0) <= -8 AND product_age_months >= 12"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("x13_snapshot_override", f"""
SELECT {_KEY}, CASE WHEN pred = 'healthy' AND {_SEVERE} THEN 'high_fatigue' WHEN pred = 'healthy' AND {_DRIFT} THEN 'moderate_fatigue' ELSE pred END AS pred,
  {r6(f'''CASE WHEN pred = 'healthy' AND {_SEVERE} THEN greatest(0.72, least(0.93, 1.0 - confidence * 0.15::DOUBLE))
  WHEN pred = 'healthy' AND {_DRIFT} THEN greatest(0.62, least(0.84, 1.0 - confidence * 0.2::DOUBLE)) ELSE confidence END''')} AS confidence,
  CASE WHEN pred = 'healthy' AND {_SEVERE} THEN {_quote(scoring.OVERRIDE_STRONG)}
    WHEN pred = 'healthy' AND {_DRIFT} THEN {_quote(scoring.OVERRIDE_MODERATE)} END AS warning
FROM reviews_scored""")
def _(t: Tables):
    return keyed(scoring.snapshot_override(scored(t, "reviews")), "pred", "confidence", F.col("override_warning").alias("warning"))


@query("x16_compare_two_inputs", f"""
SELECT a.product, {r6('a.risk_score', 2)} AS risk_score, {r6('b.risk_score', 2)} AS compare_score, {r6('b.risk_score - a.risk_score', 2)} AS delta
FROM (SELECT product, arg_max(risk_score, month) AS risk_score FROM sales_risk GROUP BY 1) a
JOIN (SELECT product, arg_max(risk_score, month) AS risk_score FROM reviews_risk GROUP BY 1) b USING (product)""")
def _(t: Tables):
    a = scoring.latest_rows(scoring.risk(scored(t, "sales")), "product", "month", ["risk_score"]).drop("month")
    b = scoring.latest_rows(scoring.risk(scored(t, "reviews")), "product", "month", ["risk_score"]).select(
        "product", F.col("risk_score").alias("compare_score")
    )
    out = a.join(b, "product").withColumn("delta", F.col("compare_score") - F.col("risk_score"))
    return portable(out, digits=2)


@query("x18_alerts_and_actions", f"""
SELECT {_KEY}, concat_ws(' | ', CASE WHEN margin < 0.15 THEN 'narrow margin' END, CASE WHEN share < 0.7 THEN {_quote(scoring.ALERT_SPARSE)} END,
  CASE WHEN customer_concentration > 1 THEN {_quote(scoring.ALERT_DRIVER['sales'][1])} END) AS alerts, {_quote(' | '.join(scoring.ACTIONS['sales']))} AS actions
FROM (SELECT *, ((revenue_velocity IS NOT NULL)::INT + (revenue_acceleration IS NOT NULL)::INT + 1) / 3.0 AS share FROM sales_margins)""")
def _(t: Tables):
    df = scored(t, "sales").withColumn(
        "completeness", validation.completeness(["revenue_velocity", "revenue_acceleration", "revenue_total"])
    )
    warnings = F.array_compact(F.array(F.when(P.margin(F.col("p")) < 0.15, "narrow margin")))
    top = F.when(F.col("customer_concentration") > 1, F.array(F.lit("customer_concentration"))).otherwise(
        F.array().cast("array<string>")
    )
    return keyed(
        df, F.array_join(scoring.alerts("sales", warnings, F.col("completeness"), top), " | ").alias("alerts"),
        F.array_join(scoring.actions("sales"), " | ").alias("actions"),
    )


@query("t5_capped_alert_lists", f"""
SELECT {_KEY}, least(4, (margin < 0.15)::INT + (share < 0.7)::INT + (confidence < 0.6)::INT + (p1 > 0.3)::INT + (p2 > 0.3)::INT)::BIGINT AS n_alerts
FROM (SELECT *, ((revenue_velocity IS NOT NULL)::INT + (revenue_acceleration IS NOT NULL)::INT + 1) / 3.0 AS share FROM sales_margins)""")
def _(t: Tables):
    df = scored(t, "sales").withColumn(
        "completeness", validation.completeness(["revenue_velocity", "revenue_acceleration", "revenue_total"])
    )
    warnings = F.array_compact(F.array(
        F.when(P.margin(F.col("p")) < 0.15, "narrow margin"), F.when(F.col("confidence") < 0.6, "low confidence"),
        F.when(prob(1) > 0.3, "high class likely"), F.when(prob(2) > 0.3, "moderate class likely"),
    ))
    none = F.array().cast("array<string>")
    return keyed(df, F.size(scoring.alerts("sales", warnings, F.col("completeness"), none)).alias("n_alerts"))


fragment("sales_trajectory", """
SELECT *, risk_score - lag(risk_score) OVER (PARTITION BY product ORDER BY month) AS trend_vs_last_period,
  row_number() OVER (PARTITION BY product ORDER BY month DESC) AS age FROM sales_risk""")


@query("w15_risk_trend", f"SELECT {_KEY}, {r6('trend_vs_last_period', 2)} AS trend FROM sales_trajectory")
def _(t: Tables):
    df = scoring.trend(scoring.risk(scored(t, "sales")), "product", "month")
    return keyed(df, rounded(F.col("trend_vs_last_period"), 2).alias("trend"))


@query("x21_scored_trajectory", f"""
SELECT {_KEY}, risk_score, {r6('trend_vs_last_period', 2)} AS trend, risk_score >= 35 AS above_moderate_line, risk_score >= 70 AS above_high_line
FROM sales_trajectory WHERE age <= 12""")
def _(t: Tables):
    df = scoring.trajectory(scoring.risk(scored(t, "sales")), "product", "month", 12)
    return keyed(df, "risk_score", rounded(F.col("trend_vs_last_period"), 2).alias("trend"), "above_moderate_line", "above_high_line")


@query("x24_confidence_interval", f"""
SELECT {_KEY}, {r6('greatest(risk_score - 12 * (1 - confidence), 0)')} AS score_low, {r6('least(risk_score + 12 * (1 - confidence), 100)')} AS score_high
FROM sales_trajectory WHERE age <= 24""")
def _(t: Tables):
    df = scoring.trajectory(scoring.risk(scored(t, "sales")), "product", "month", 24)
    return keyed(df, "score_low", "score_high")


_CONTRIB = ("revenue_velocity", "customer_churn_rate", "aov_change")


@query("x25_ranked_drivers", f"""
SELECT product, feature, {r6('value')} AS value, {r6('abs(value) / greatest(max(abs(value)) OVER (PARTITION BY product), 0.01)')} AS width,
  row_number() OVER (PARTITION BY product ORDER BY round(abs(value), 9) DESC, feature) AS position FROM (
  {' UNION ALL '.join(f"SELECT product, '{c}' AS feature, round(avg({c}), 6) AS value FROM brand_sales_scored GROUP BY 1" for c in _CONTRIB)})""")
def _(t: Tables):
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("value")) for c in _CONTRIB])
    means = scored(t, "sales", "brand").groupBy("product").agg(*[F.avg(c).alias(c) for c in _CONTRIB])
    long = means.select("product", F.inline(items))
    return portable(scoring.ranked_drivers(long, ["product"], "feature", "value"))


# ----------------------------------------------------------------- I8 on scored rows


def _poisson_steps() -> list[float]:
    steps, total, term = [], 0.0, math.exp(-1.0)
    for count in range(8):
        total += term
        steps.append(total)
        term /= count + 1
    return steps


_BOOT_KEY = "product || '|' || strftime(month, '%Y-%m-%d') || '#' || replicate::VARCHAR"
_BOOT_U = f"({sql_bucket(_BOOT_KEY)} / 1000000.0::DOUBLE)"
fragment("boot_rows", f"""
SELECT replicate, y, pred, {' + '.join(f'({_BOOT_U} >= {c!r}::DOUBLE)::INT' for c in _poisson_steps())} AS w
FROM brand_sales_scored, (SELECT unnest(generate_series(1, 10)) AS replicate)""")
fragment("boot_f1", """
SELECT replicate, avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS f1 FROM (
  SELECT replicate, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT replicate, y AS class, w * (y = pred)::INT AS tp, 0 AS fp, w * (y <> pred)::INT AS fn FROM boot_rows
    UNION ALL SELECT replicate, pred, 0, w * (y <> pred)::INT, 0 FROM boot_rows) GROUP BY ALL)
WHERE 2 * tp + fp + fn > 0 GROUP BY replicate""")


@query("i8_bootstrap_of_scored_rows", f"""
SELECT {r6('avg(f1)')} AS mean_f1, {r6('stddev_pop(f1)')} AS std_f1, {r6('quantile_cont(f1, 0.025)')} AS ci_low,
  {r6('quantile_cont(f1, 0.975)')} AS ci_high,
  CASE WHEN stddev_pop(f1) < 0.02 THEN 'Stable' WHEN stddev_pop(f1) < 0.04 THEN 'Moderate' ELSE 'Unstable' END AS stability
FROM boot_f1""")
def _(t: Tables):
    from ebbtide.operators.audit import bootstrap

    key = F.concat_ws("|", "product", F.date_format("month", "yyyy-MM-dd"))
    return portable(bootstrap(scored(t, "sales", "brand"), key, 10))
