"""Leakage-safe history features: every value uses only earlier periods as its reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators.signals import series


def trailing_mean(c: Column, w, periods: int = 3, minimum: int = 2) -> Column:
    """Mean of the previous ``periods`` rows when at least ``minimum`` of them have a value."""
    frame = w.rowsBetween(-periods, -1)
    return F.when(F.count(c).over(frame) >= minimum, F.avg(c).over(frame))


def percent_from_previous(c: Column, w) -> Column:
    previous = F.lag(c).over(w)
    return S.ratio(c - previous, previous) * 100


def usage_history(panel: DataFrame) -> DataFrame:
    w = series(specs.USAGE)
    cols = [
        trailing_mean(F.col(c), w).alias(f"roll3_mean_{c}")
        for c in specs.USAGE.trailing_mean_columns
        if c in panel.columns
    ]
    if "engagement_per_session" in panel.columns:
        cols.append(
            percent_from_previous(F.col("engagement_per_session"), w).alias(
                "safe_engagement_quality_change"
            )
        )
    return panel.select("*", *cols)


def reviews_history(panel: DataFrame) -> DataFrame:
    w = series(specs.REVIEWS)
    cols = []
    for c in specs.REVIEWS.trailing_mean_columns:
        if c in panel.columns:
            trailing = trailing_mean(F.col(c), w)
            cols.append(trailing.alias(f"roll3_mean_{c}"))
            cols.append((F.col(c) - trailing).alias(f"{c}_vs_trailing_mean"))
    if "sentiment_mean" in panel.columns:
        mean = F.col("sentiment_mean")
        cols.append((mean - F.lag(mean).over(w)).alias("safe_sentiment_change"))
    if "review_count" in panel.columns:
        cols.append(
            percent_from_previous(F.col("review_count"), w).alias("safe_review_count_change_pct")
        )
    return panel.select("*", *cols)


def derived_features(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    """Per-transaction and interaction columns for the inputs that are present."""
    have = set(panel.columns)
    out: list[Column] = []

    def product(name: str, a: str, b: str) -> None:
        if {a, b} <= have:
            out.append((F.col(a) * F.col(b)).alias(name))

    if spec.name == "sales":
        for name, top in (
            ("revenue_per_transaction", "revenue_total"),
            ("quantity_per_transaction", "quantity_sold"),
        ):
            if {top, "transaction_count"} <= have:
                out.append(S.ratio(F.col(top), F.col("transaction_count")).alias(name))
        product("revenue_x_concentration", "revenue_total", "customer_concentration")
        product("aov_x_freq_change", "aov_change", "order_frequency_change")
    elif spec.name == "reviews":
        product("sentiment_x_volume", "sentiment_mean", "review_count")
        product("volatility_x_volume", "sentiment_std", "review_count")
    else:
        product("engagement_x_conversion", "engagement_total", "conversion_rate")
        product("full_funnel_rate", "view_to_cart_rate", "cart_to_purchase_rate")
    return panel.select("*", *out)


def history_features(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    if spec.name == "usage":
        return usage_history(panel)
    if spec.name == "reviews":
        return reviews_history(panel)
    return panel
