"""Change signals over each product's observed periods (row-based, gaps are not filled)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S


def series(spec: specs.SourceSpec):
    return Window.partitionBy(spec.id_col).orderBy(spec.time_col)


def difference(c: Column, w) -> Column:
    return c - F.lag(c).over(w)


def percent_change(c: Column, w) -> Column:
    """Relative change in percent; NULL on a missing or zero previous value."""
    return (S.ratio(c, F.lag(c).over(w)) - 1) * 100


def rolling_std(c: Column, w, periods: int = 3) -> Column:
    """Sample deviation of the current and previous periods; NULL for a single value."""
    return F.stddev_samp(c).over(w.rowsBetween(1 - periods, 0))


def reviews_signals(panel: DataFrame) -> DataFrame:
    w = series(specs.REVIEWS)
    mean = F.col("sentiment_mean")
    first = panel.select(
        "*",
        difference(mean, w).alias("sentiment_velocity"),
        rolling_std(mean, w).alias("sentiment_volatility"),
        percent_change(F.col("review_count"), w).alias("review_momentum"),
        (F.col("score_max") - F.col("score_min")).alias("sentiment_polarization"),
        percent_change(F.col("unique_reviewers"), w).alias("reviewer_diversity_change"),
    )
    return first.withColumn(
        "sentiment_acceleration", difference(F.col("sentiment_velocity"), w)
    )


def sales_signals(panel: DataFrame) -> DataFrame:
    w = series(specs.SALES)
    revenue = F.col("revenue_total")
    base = panel.withColumn("aov", S.ratio(revenue, F.col("unique_orders")))
    first = base.select(
        "*",
        percent_change(revenue, w).alias("revenue_velocity"),
        percent_change(F.col("unique_customers"), w).alias("customer_churn_rate"),
        rolling_std(revenue, w).alias("revenue_volatility"),
        percent_change(F.col("unique_orders"), w).alias("order_frequency_change"),
        percent_change(F.col("aov"), w).alias("aov_change"),
        S.ratio(F.col("unique_customers"), F.col("transaction_count")).alias(
            "customer_concentration"
        ),
    )
    return first.withColumn("revenue_acceleration", difference(F.col("revenue_velocity"), w))


def usage_funnel(panel: DataFrame) -> DataFrame:
    return panel.select(
        "*",
        S.percent(F.col("cart_count"), F.col("view_count")).alias("view_to_cart_rate"),
        S.percent(F.col("purchase_count"), F.col("cart_count")).alias("cart_to_purchase_rate"),
        S.percent(F.col("purchase_count"), F.col("event_count")).alias("conversion_rate"),
        S.percent(F.col("purchase_count"), F.col("view_count")).alias("funnel_efficiency"),
        S.ratio(F.col("engagement_total"), F.col("unique_sessions")).alias(
            "engagement_per_session"
        ),
    )


def usage_signals(panel: DataFrame) -> DataFrame:
    w = series(specs.USAGE)
    total = F.col("engagement_total")
    first = usage_funnel(panel).select(
        "*",
        percent_change(total, w).alias("engagement_velocity"),
        percent_change(F.col("active_users"), w).alias("user_retention_rate"),
        percent_change(F.col("unique_sessions"), w).alias("session_frequency_change"),
        difference(F.col("conversion_rate"), w).alias("conversion_rate_change"),
        rolling_std(total, w).alias("engagement_volatility"),
        percent_change(F.col("purchase_count"), w).alias("purchase_momentum"),
        difference(F.col("funnel_efficiency"), w).alias("funnel_efficiency_change"),
        percent_change(F.col("engagement_per_session"), w).alias("engagement_quality_change"),
    )
    return first.withColumn(
        "engagement_acceleration", difference(F.col("engagement_velocity"), w)
    )


def z_parameters(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    """One row: mean and population deviation of each signal with NULL counted as 0."""
    aggs = []
    for out, col in spec.z_columns:
        filled = F.coalesce(F.col(col), F.lit(0.0))
        aggs += [F.avg(filled).alias(f"mean_{out}"), F.stddev_pop(filled).alias(f"std_{out}")]
    return panel.agg(*aggs)


def z_scores(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    """Global z columns; the parameters come in as one scalar subquery row."""
    params = z_parameters(panel, spec)
    row = params.select(F.struct(*params.columns)).scalar()
    cols = []
    for out, col in spec.z_columns:
        filled = F.coalesce(F.col(col), F.lit(0.0))
        cols.append(
            S.ratio(filled - row.getField(f"mean_{out}"), row.getField(f"std_{out}")).alias(out)
        )
    return panel.select("*", *cols)


def z_outliers(scored: DataFrame, spec: specs.SourceSpec, below: float = -3.0) -> DataFrame:
    """Rows with any z column below the bound."""
    hit = F.lit(False)
    for out, _ in spec.z_columns:
        hit = hit | (F.col(out) < below)
    return scored.where(hit)


SIGNALS = {"reviews": reviews_signals, "sales": sales_signals, "usage": usage_signals}
