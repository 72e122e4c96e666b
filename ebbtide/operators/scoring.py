"""Rules and read models on scored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import probability as P

# ---- fixed values: messages and actions ----
CALIBRATION_CHANGED = "Calibration changed class prediction — check dataset consistency"
RAW_TOO_CONFIDENT = "Raw confidence still high — check for leakage or overfitting"
CALIBRATED_TOO_CONFIDENT = "Calibrated confidence still high — check for leakage or overfitting"
OVERRIDE_STRONG = "Review snapshot fallback applied because strong fatigue signals were present without history features."
OVERRIDE_MODERATE = "Review snapshot fallback applied because moderate fatigue signals were present without history features."
ALERT_SPARSE = "Low data completeness detected. Confidence may be optimistic for sparse inputs."
ALERT_DRIVER = {
    "reviews": ("reviewer_diversity_change", "Reviewer diversity is a primary fatigue driver."),
    "sales": ("customer_concentration", "Revenue concentration risk is elevated."),
    "usage": ("funnel_efficiency", "Usage funnel degradation is materially impacting risk."),
}
ACTIONS = {
    "reviews": (
        "Refresh review acquisition and reactivate high-quality reviewers.",
        "Investigate negative sentiment themes before sentiment volatility compounds.",
        "Audit lifecycle messaging for mature products with softening cadence.",
    ),
    "sales": (
        "Reduce customer concentration through broader acquisition campaigns.",
        "Test pricing or bundle adjustments to stabilize order frequency and AOV.",
        "Prioritize churn intervention on products showing repeat-order decay.",
    ),
    "usage": (
        "Repair funnel leakage before increasing top-of-funnel traffic.",
        "Increase depth of engagement with onboarding or in-product prompts.",
        "Run conversion experiments on the highest-friction session path.",
    ),
}
DRIVER_USAGE = "strong behavioral fatigue signal"
DRIVER_REVIEWS = "emotional deterioration detected"
DRIVER_SALES = "commercial performance declining"
DRIVER_NONE = "No dominant fatigue driver"
# ---- end of fixed values ----


def latest_rows(df: DataFrame, id_col: str, time_col: str, cols: Sequence[str]) -> DataFrame:
    """The last period of each product (an aggregate, combined before the shuffle)."""
    packed = F.max_by(F.struct(*cols), time_col).alias("_row")
    return df.groupBy(id_col).agg(F.max(time_col).alias(time_col), packed).select(
        id_col, time_col, "_row.*"
    )


def uncertainty(df: DataFrame, p: str = "p") -> DataFrame:
    top = P.top_probability(F.col(p))
    return df.withColumns({
        "max_probability": top,
        "margin": P.margin(F.col(p)),
        "confidence_band": P.confidence_band(top),
        "uncertainty_flag": P.needs_review(F.col(p)),
    })


def compare_calibration(df: DataFrame, raw: str, calibrated: str) -> DataFrame:
    """Raw against calibrated class and confidence, with warnings; NULL calibrated is allowed."""
    r, c = F.col(raw), F.col(calibrated)
    raw_conf, cal_conf = P.top_probability(r), P.top_probability(c)
    raw_class = P.class_at(P.arg_max(r), specs.CLASSES)
    cal_class = P.class_at(P.arg_max(c), specs.CLASSES)
    without = c.isNull()
    return df.withColumns({
        "raw_class": raw_class,
        "raw_confidence": raw_conf,
        "calibrated_class": cal_class,
        "calibrated_confidence": cal_conf,
        "adjustment": cal_conf - raw_conf,
        "prediction_changed": raw_class != cal_class,
        "warnings": F.array_compact(F.array(
            F.when(without & (raw_conf > P.OVERCONFIDENT_ABOVE), RAW_TOO_CONFIDENT),
            F.when(raw_class != cal_class, CALIBRATION_CHANGED),
            F.when(cal_conf > P.OVERCONFIDENT_ABOVE, CALIBRATED_TOO_CONFIDENT),
        )),
    })


def snapshot_override(df: DataFrame, pred: str = "pred", confidence: str = "confidence") -> DataFrame:
    """Raise a healthy review prediction on strong snapshot signals when history is absent."""

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    history = [c for c in specs.REVIEW_HISTORY_COLUMNS if c in df.columns]
    absent = F.lit(True)
    for c in history:
        absent = absent & F.col(c).isNull()
    median, mean = given("score_median"), given("sentiment_mean")
    diversity, age = given("reviewer_diversity_change"), given("product_age_months")
    conf = F.col(confidence)
    eligible = (F.col(pred) == specs.HEALTHY) & absent
    severe = eligible & (median <= 2.5) & (mean <= 0.25) & (diversity <= -20) & (age >= 18)
    drifting = eligible & (median <= 3.2) & (mean <= 0.6) & (diversity <= -8) & (age >= 12)

    def bounded(low: float, high: float, slope: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), 1.0 - conf * slope))

    return df.withColumns({
        pred: F.when(severe, specs.HIGH).when(drifting, specs.MODERATE).otherwise(F.col(pred)),
        confidence: F.when(severe, bounded(0.72, 0.93, 0.15))
        .when(drifting, bounded(0.62, 0.84, 0.2)).otherwise(conf),
        "overridden": severe | drifting,
        "override_warning": F.when(severe, OVERRIDE_STRONG).when(drifting, OVERRIDE_MODERATE),
    })


def risk(df: DataFrame, pred: str = "pred", confidence: str = "confidence") -> DataFrame:
    scored = df.withColumn("risk_score", P.risk_score(F.col(pred), F.col(confidence)))
    return scored.withColumn("risk_band", P.risk_band(F.col("risk_score")))


def fatigue_index(branches: Mapping[str, Column], clip: bool = True) -> Column:
    """Weighted sum of each branch's P(high); a branch without a weight counts 1/n."""
    total = F.lit(0.0)
    for name, high in branches.items():
        weight = specs.BRANCH_WEIGHTS.get(name, 1.0 / len(branches))
        total = total + F.coalesce(high, F.lit(0.0)) * weight
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) if clip else total


def recommended_action(pred: Column, uncertain: Column) -> Column:
    return (
        F.when((pred == specs.HIGH) & ~uncertain, "urgent intervention")
        .when(pred == specs.MODERATE, "proactive monitoring")
        .when(uncertain, "manual review needed")
        .otherwise("monitor")
    )


def driver_summary(
    usage_high: Column, reviews_high: Column, reviews_moderate: Column,
    sales_high: Column, sales_moderate: Column,
) -> Column:
    drivers = F.array_compact(F.array(
        F.when(usage_high > 0.5, DRIVER_USAGE),
        F.when((reviews_high > 0.3) | (reviews_moderate > 0.5), DRIVER_REVIEWS),
        F.when((sales_high > 0.3) | (sales_moderate > 0.5), DRIVER_SALES),
    ))
    return F.when(F.size(drivers) == 0, DRIVER_NONE).otherwise(F.concat_ws("; ", drivers))


def alerts(source: str, warnings: Column, completeness: Column, top_features: Column) -> Column:
    """At most four alerts: the row's warnings first, then sparsity and the source's main driver."""
    feature, message = ALERT_DRIVER[source]
    extra = F.array_compact(F.array(
        F.when(completeness < 0.7, ALERT_SPARSE),
        F.when(F.array_contains(top_features, feature), message),
    ))
    return F.slice(F.concat(warnings, extra), 1, 4)


def actions(source: str) -> Column:
    return F.slice(F.array(*[F.lit(a) for a in ACTIONS[source]]), 1, 3)


def trend(df: DataFrame, id_col: str, time_col: str, score: str = "risk_score") -> DataFrame:
    """Change of the score since the product's previous scored period."""
    w = Window.partitionBy(id_col).orderBy(time_col)
    return df.withColumn("trend_vs_last_period", F.col(score) - F.lag(score).over(w))


def trajectory(
    df: DataFrame, id_col: str, time_col: str, periods: int = 12, score: str = "risk_score",
    confidence: str = "confidence",
) -> DataFrame:
    """The last scored periods of each product with the confidence interval around the score."""
    newest = Window.partitionBy(id_col).orderBy(F.desc(time_col))
    recent = trend(df, id_col, time_col, score).withColumn(
        "_age", F.row_number().over(newest)
    ).where(F.col("_age") <= periods).drop("_age")
    low, high = P.score_interval(F.col(score), F.col(confidence))
    return recent.withColumns({
        "score_low": low, "score_high": high,
        "above_moderate_line": F.col(score) >= 35, "above_high_line": F.col(score) >= 70,
    })


def ranked_drivers(df: DataFrame, id_cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Contributions of a row by absolute size, with the width relative to the largest."""
    row = Window.partitionBy(*id_cols)
    size = F.abs(F.col(value))
    return df.withColumns({
        "width": size / F.greatest(F.max(size).over(row), F.lit(0.01)),
        "position": F.row_number().over(row.orderBy(F.desc(size), name)),
    })
