"""Fixed descriptions of the three sources: column names, bounds, word lists, weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Class names in label-code order (alphabetical).
CLASSES = ("healthy", "high_fatigue", "moderate_fatigue")
HEALTHY, HIGH, MODERATE = CLASSES
FATIGUED = "fatigued"
BINARY_CLASSES = (FATIGUED, HEALTHY)

SEED = 42


@dataclass(frozen=True)
class SourceSpec:
    """How one source is keyed, ordered and summarised."""

    name: str
    title: str
    dimension: str
    id_col: str
    first_seen_col: str
    stage_bounds: tuple[float, float, float]
    primary_signal: str
    primary_signal_title: str
    decline_column: str
    decline_below: float
    decline_min_age: float
    z_columns: tuple[tuple[str, str], ...]
    correlation_columns: tuple[str, ...]
    trailing_mean_columns: tuple[str, ...]
    age_dev_columns: tuple[str, ...]
    time_col: str = "month"


# ---- fixed values: thresholds, column lists and weights the results depend on ----

REVIEWS = SourceSpec(
    name="reviews",
    title="Reviews",
    dimension="Emotional",
    id_col="ProductId",
    first_seen_col="first_review_date",
    stage_bounds=(3, 12, 24),
    primary_signal="sentiment_velocity",
    primary_signal_title="Sentiment Velocity",
    decline_column="sentiment_velocity",
    decline_below=-0.1,
    decline_min_age=6,
    z_columns=(
        ("z_sentiment_velocity", "sentiment_velocity"),
        ("z_sentiment_acceleration", "sentiment_acceleration"),
    ),
    correlation_columns=(
        "sentiment_mean", "sentiment_std", "sentiment_velocity", "sentiment_acceleration",
        "sentiment_volatility", "review_momentum", "sentiment_polarization", "product_age_months",
    ),
    trailing_mean_columns=(
        "sentiment_mean", "review_count", "score_median", "reviewer_diversity_change",
    ),
    age_dev_columns=("sentiment_mean", "review_count"),
)

SALES = SourceSpec(
    name="sales",
    title="Sales",
    dimension="Financial",
    id_col="StockCode",
    first_seen_col="first_sale_date",
    stage_bounds=(3, 12, 24),
    primary_signal="revenue_velocity",
    primary_signal_title="Revenue Velocity",
    decline_column="revenue_velocity",
    decline_below=-15.0,
    decline_min_age=6,
    z_columns=(
        ("z_revenue_velocity", "revenue_velocity"),
        ("z_customer_churn", "customer_churn_rate"),
    ),
    correlation_columns=(
        "revenue_total", "revenue_velocity", "revenue_acceleration", "revenue_volatility",
        "customer_churn_rate", "order_frequency_change", "aov_change", "product_age_months",
    ),
    trailing_mean_columns=(),
    age_dev_columns=("revenue_total", "transaction_count"),
)

USAGE = SourceSpec(
    name="usage",
    title="Usage",
    dimension="Behavioral",
    id_col="product_id",
    first_seen_col="first_event_date",
    stage_bounds=(1, 3, 6),
    primary_signal="engagement_velocity",
    primary_signal_title="Engagement Velocity",
    decline_column="engagement_velocity",
    decline_below=-20.0,
    decline_min_age=1,
    z_columns=(
        ("z_engagement_velocity", "engagement_velocity"),
        ("z_user_retention", "user_retention_rate"),
        ("z_conversion_change", "conversion_rate_change"),
    ),
    correlation_columns=(
        "engagement_total", "engagement_velocity", "engagement_acceleration",
        "engagement_volatility", "user_retention_rate", "conversion_rate",
        "conversion_rate_change", "purchase_momentum", "funnel_efficiency",
        "product_age_months",
    ),
    trailing_mean_columns=(
        "active_users", "engagement_total", "purchase_count", "conversion_rate", "unique_sessions",
    ),
    age_dev_columns=("engagement_total", "conversion_rate", "purchase_count"),
)

SOURCES = {s.name: s for s in (REVIEWS, SALES, USAGE)}

RATING_SENTIMENT = {1: -1.0, 2: -0.5, 3: 0.0, 4: 0.5, 5: 1.0}
EVENT_WEIGHTS = {"view": 1, "cart": 5, "purchase": 15}

ID_TIME_TARGET_COLUMNS = (
    "ProductId", "StockCode", "product_id", "month", "month_date",
    "first_review_date", "first_sale_date", "first_event_date",
    "fatigue_label", "fatigue_score",
)
GLOBAL_Z_COLUMNS = (
    "z_sentiment_velocity", "z_sentiment_acceleration",
    "z_revenue_velocity", "z_customer_churn",
    "z_engagement_velocity", "z_user_retention", "z_conversion_change",
)
LABEL_DERIVED_COLUMNS = (
    "sentiment_acceleration", "sentiment_volatility", "review_momentum",
    "revenue_acceleration", "customer_churn_rate", "revenue_volatility",
    "engagement_acceleration", "user_retention_rate", "conversion_rate_change",
    "purchase_momentum",
    "funnel_efficiency_change", "engagement_volatility", "engagement_quality_change",
)

COMPLAINT_WORDS = (
    "broken", "defective", "terrible", "worst", "waste", "return", "refund", "disappointed",
    "awful", "horrible", "junk", "garbage", "useless", "regret", "scam",
)

REVIEW_HISTORY_COLUMNS = (
    "roll3_mean_sentiment_mean", "sentiment_mean_vs_trailing_mean",
    "roll3_mean_review_count", "review_count_vs_trailing_mean",
    "roll3_mean_score_median", "score_median_vs_trailing_mean",
    "roll3_mean_reviewer_diversity_change", "reviewer_diversity_change_vs_trailing_mean",
    "safe_sentiment_change",
)

BRANCH_WEIGHTS = {"reviews": 0.3, "sales": 0.3, "usage": 0.4}

THRESHOLD_GRID = tuple(float(x) for x in np.linspace(0.05, 0.95, 91))
HEALTHY_WEIGHT_GRID = (0.35, 0.5, 0.65, 0.8, 1.0)
FATIGUE_WEIGHT_GRID = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0)
CASE_HEALTHY_WEIGHT_GRID = (1.0, 0.8, 0.65, 0.5, 0.35)
CASE_FATIGUE_WEIGHT_GRID = (1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0)

# Name fragments that select the columns removed by each ablation.
ABLATION_FRAGMENTS = {
    "no_product_age": ("product_age", "lifecycle"),
    "no_rolling_features": ("roll3", "lag", "slope"),
    "only_base_features": ("roll3", "lag", "slope", "log_diff", "vs_trailing", "safe_", "_age_dev"),
}
ABLATION_PREFIXES = {"no_text_features": ("sbert_", "nlp_")}
ABLATION_BY_SOURCE = {
    "reviews": ("no_sentiment", ("sentiment",)),
    "sales": ("no_revenue", ("revenue",)),
    "usage": ("no_funnel", ("cart", "purchase", "conversion")),
}

RATIO_FRAGMENTS = ("_per_", "_rate", "_ratio", "_change")

RUN_LOG_COLUMNS = (
    ("timestamp", "string"), ("modality", "string"), ("model", "string"),
    ("n_features", "bigint"), ("n_train", "bigint"), ("n_test", "bigint"),
    ("cv_f1", "double"), ("test_f1", "double"), ("cv_test_gap", "double"),
    ("optimal_threshold", "double"), ("balanced_accuracy", "double"),
    ("macro_recall", "double"), ("prediction_distribution_drift_l1", "double"),
    ("scenario_score", "double"), ("raw_brier_score", "double"), ("raw_ece", "double"),
    ("calibrated_brier_score", "double"), ("calibrated_ece", "double"),
    ("best_params", "string"),
)
# ---- end of fixed values ----
