"""Decline labels: same-period rules, severity relabelling and forward-looking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators.quantiles import quantile_values


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def emotional_label() -> Column:
    mean = F.col("sentiment_mean")
    velocity, acceleration = _zero("sentiment_velocity"), _zero("sentiment_acceleration")
    volatility, momentum = _zero("sentiment_volatility"), _zero("review_momentum")
    severe = (mean < -0.2) & (velocity < -0.15) & (acceleration < -0.05) & (momentum < -20)
    drifting = ((mean < 0) & (velocity < -0.05)) | ((momentum < -15) & (volatility > 0.3))
    return _three_way(severe, drifting)


def financial_label() -> Column:
    velocity, acceleration = _zero("revenue_velocity"), _zero("revenue_acceleration")
    churn, volatility = _zero("customer_churn_rate"), _zero("revenue_volatility")
    severe = (velocity < -20) & (churn < -15) & (acceleration < -10)
    drifting = (velocity < -10) | ((churn < -10) & (volatility > F.col("revenue_total") * 0.5))
    return _three_way(severe, drifting)


def behavioural_label() -> Column:
    velocity, acceleration = _zero("engagement_velocity"), _zero("engagement_acceleration")
    retention, momentum = _zero("user_retention_rate"), _zero("purchase_momentum")
    conversion_change = _zero("conversion_rate_change")
    severe = (velocity < -25) & (retention < -20) & (momentum < -30) & (acceleration < -15)
    drifting = (
        ((velocity < -15) & (retention < -10))
        | ((conversion_change < -2) & (momentum < -15))
        | ((velocity < -20) & (F.col("conversion_rate") < 2))
    )
    return _three_way(severe, drifting)


def _three_way(severe: Column, drifting: Column) -> Column:
    return F.when(severe, specs.HIGH).when(drifting, specs.MODERATE).otherwise(specs.HEALTHY)


SAME_PERIOD = {
    "reviews": emotional_label, "sales": financial_label, "usage": behavioural_label,
}


def with_label(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    return panel.withColumn("fatigue_label", SAME_PERIOD[spec.name]())


def binary_label(label: Column) -> Column:
    return F.when(label.isin(specs.HIGH, specs.MODERATE), specs.FATIGUED).otherwise(label)


def usage_severity(panel: DataFrame, needed: int = 4) -> DataFrame:
    """Moderate usage rows with enough severe conditions become high."""
    limits = (  # fixed values: column, upper bound, value used when missing
        ("purchase_count", 0, 0), ("conversion_rate", 0, 0), ("funnel_efficiency", 0, 0),
        ("cart_count", 1, 0), ("engagement_total", 45, 0), ("view_to_cart_rate", 0.5, 0),
        ("engagement_per_session", 1.14, 99),
    )
    hits = sum(
        (F.coalesce(F.col(c).cast("double"), F.lit(float(missing))) <= bound).cast("int")
        for c, bound, missing in limits
    )
    raised = (F.col("fatigue_label") == specs.MODERATE) & (hits >= needed)
    return panel.withColumn(
        "fatigue_label", F.when(raised, specs.HIGH).otherwise(F.col("fatigue_label"))
    )


# Forward score parts: column, weight, value when missing now, +1 decline / -1 increase.
FORWARD_PARTS = {
    "reviews": (
        ("sentiment_mean", 0.5, None, 1), ("sentiment_std", 0.25, 0.0, -1),
        ("review_count", 0.25, 1.0, 1),
    ),
    "sales": (
        ("revenue_total", 0.5, 0.0, 1), ("transaction_count", 0.3, 1.0, 1),
        ("avg_price", 0.2, 0.0, 1),
    ),
    "usage": (
        ("engagement_total", 0.4, 0.0, 1), ("conversion_rate", 0.35, 0.0, 1),
        ("purchase_count", 0.25, 0.0, 1),
    ),
}


def forward_score(panel: DataFrame, spec: specs.SourceSpec, horizon: int = 4) -> DataFrame:
    """Add ``fatigue_score`` in [0, 1] from the next ``horizon`` observed periods.

    Rows without any later period, or without a current value where none may be assumed, get NULL.
    """
    order = Window.partitionBy(spec.id_col).orderBy(spec.time_col)
    ahead = order.rowsBetween(1, horizon)
    total = F.lit(0.0)
    scored = F.lead(F.lit(1)).over(order).isNotNull()
    for name, weight, missing, sign in FORWARD_PARTS[spec.name]:
        if name not in panel.columns:
            continue
        value = F.col(name).cast("double")
        now = value if missing is None else F.coalesce(value, F.lit(missing))
        if missing is None:
            scored = scored & value.isNotNull()
        change = (now - F.avg(value).over(ahead)) * sign
        worsening = F.greatest(change, F.lit(0.0)) / F.greatest(F.abs(now), F.lit(0.01))
        total = total + worsening * weight
    return panel.withColumn(
        "fatigue_score", F.when(scored, F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    )


def score_to_class(
    df: DataFrame,
    method: str = "quantile",
    binary: bool = False,
    thresholds: tuple[float, float] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Label rows by their ``fatigue_score``; cut points are fitted on ``fit_on`` when given."""
    score = F.col("fatigue_score")
    fitted = fit_on if fit_on is not None else df
    if binary:
        if method == "fixed":
            cut = (thresholds or (0.5,))[0]
        else:
            cut = quantile_values(fitted, [("fatigue_score", 0.5)], hold=True)[("fatigue_score", 0.5)]
        label = F.when(score <= cut, specs.HEALTHY).otherwise(specs.FATIGUED)
        return df.withColumn("fatigue_label", F.when(score.isNotNull(), label))
    lo, hi = thresholds or (0.33, 0.66)
    if method == "quantile" or lo >= hi:
        asks = [("fatigue_score", 0.33), ("fatigue_score", 0.66)]
        found = quantile_values(fitted, asks, hold=True)
        lo, hi = found.values()
    if lo is None or lo >= hi:
        lo, hi = 0.2, 0.5
    label = (
        F.when(score <= lo, specs.HEALTHY).when(score <= hi, specs.MODERATE).otherwise(specs.HIGH)
    )
    return df.withColumn("fatigue_label", F.when(score.isNotNull(), label))


def forward_labels(
    panel: DataFrame,
    spec: specs.SourceSpec,
    horizon: int = 4,
    method: str = "quantile",
    binary: bool = False,
) -> DataFrame:
    """Replace the label by the forward-looking one; rows without a future are dropped."""
    scored = forward_score(panel, spec, horizon)
    return score_to_class(scored, method, binary).dropna(subset=["fatigue_label"])
