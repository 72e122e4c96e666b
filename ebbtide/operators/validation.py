"""Range checks of scoring inputs, completeness and request augmentation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S

# ---- fixed values: accepted range (minimum, maximum) of every scoring input ----
INPUT_RANGES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "reviews": {
        "sentiment_mean": (-1, 1), "sentiment_std": (0, 1.5), "review_count": (0, 200),
        "score_min": (0, 5), "score_max": (0, 5), "score_median": (0, 5),
        "product_age_months": (0, 60), "sentiment_polarization": (0, 5),
        "reviewer_diversity_change": (-100, 100),
    },
    "sales": {
        "revenue_total": (0, 100000), "revenue_mean": (0, 10000), "revenue_std": (0, 10000),
        "transaction_count": (0, 500), "quantity_sold": (0, 10000), "avg_price": (0, 1000),
        "product_age_months": (0, 60), "order_frequency_change": (-100, 100),
        "aov_change": (-100, 100), "customer_concentration": (0, 1),
    },
    "usage": {
        "engagement_total": (0, 100000), "engagement_mean": (0, 1000), "cart_count": (0, 10000),
        "purchase_count": (0, 10000), "avg_price": (0, 1000), "view_to_cart_rate": (0, 100),
        "cart_to_purchase_rate": (0, 100), "conversion_rate": (0, 100),
        "product_age_months": (0, 60), "funnel_efficiency": (0, 1),
        "engagement_per_session": (0, 100), "safe_engagement_quality_change": (-100, 100),
    },
}
# ---- end of fixed values ----

MIN_COMPLETENESS = 0.65


def violations(ranges: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Names of the inputs outside their range, in table order; NULL inputs are not judged here."""
    checks = []
    for name, (low, high) in ranges.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        checks.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Add ``violations`` and ``accepted``."""
    return df.withColumn("violations", violations(ranges)).withColumn(
        "accepted", F.size("violations") == 0
    )


def completeness(required: Sequence[str]) -> Column:
    """Share of the required inputs that are present."""
    if not required:
        return F.lit(1.0)
    present = sum(F.col(c).isNotNull().cast("int") for c in required)
    return present / F.lit(len(required))


def non_zero_completeness(inputs: Sequence[str]) -> Column:
    """Share of the given numeric inputs that differ from zero, to three digits."""
    values = F.array(*[F.col(c).cast("double") for c in inputs])
    given = F.filter(values, lambda v: v.isNotNull())
    used = F.filter(given, lambda v: F.abs(v) > 1e-9)
    return F.when(F.size(given) == 0, 0.0).otherwise(F.round(F.size(used) / F.size(given), 3))


def strict_split(
    df: DataFrame, required: Sequence[str], minimum: float = MIN_COMPLETENESS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): strict scoring rejects rows with a missing or too sparse input."""
    scored = df.withColumn("completeness", completeness(required))
    fine = (F.col("completeness") >= minimum) & (F.col("completeness") == 1.0)
    return scored.where(fine), scored.where(~fine)


def augment(df: DataFrame, source: str, bounds: Sequence[float] = (3, 12, 24)) -> DataFrame:
    """Stage from age, and for usage the engagement per session when it was not given."""
    age = F.col("product_age_months")
    out = df.withColumn(
        "lifecycle_stage",
        F.when(age.isNotNull(), S.lifecycle_stage(age, bounds)),
    )
    if source == "usage":
        depth = S.ratio(F.col("engagement_total"), F.col("unique_sessions"))
        given = F.col("engagement_per_session") if "engagement_per_session" in df.columns else F.lit(None)
        out = out.withColumn("engagement_per_session", F.coalesce(given, depth))
    return out


def what_if(df: DataFrame, feature: str, percent: float) -> DataFrame:
    """The table with one feature moved by a percentage."""
    if feature not in df.columns:
        return df
    return df.withColumn(feature, F.col(feature) * (1.0 + percent / 100.0))
