"""Product-by-period panels.

Each panel is one aggregation over the log (shuffled by product and period, so a hot product is
spread over its periods and combined map-side) and one window over the small result. First-seen
dates and the minimum-history filters are taken from that window instead of extra passes over the
log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators import cleaning
from ebbtide.session import dealt, stored


def _with_history(
    agg: DataFrame, spec: specs.SourceSpec, enough: Column
) -> DataFrame:
    """Filter to products with enough history, then add first-seen date, age and stage."""
    whole = Window.partitionBy(spec.id_col)
    first = F.min("_first_in_period").over(whole)
    kept = (
        agg.withColumn(spec.first_seen_col, first)
        .withColumn("_enough", enough)
        .where("_enough")
        .drop("_enough", "_first_in_period")
    )
    age = S.age_months(F.col(spec.time_col), F.col(spec.first_seen_col))
    return kept.withColumn("product_age_months", age).withColumn(
        "lifecycle_stage", S.lifecycle_stage(F.col("product_age_months"), spec.stage_bounds)
    )


def with_distinct(rows: DataFrame, keys: Sequence[str], marks: Mapping[str, str]) -> DataFrame:
    """The rows dealt out by their keys, with a mark per column that is set in the first row of each of its values and else NULL.

    Counting a mark counts the distinct values. The rows move once, for the marks and the aggregation by the keys alike: they
    are neither multiplied nor shuffled again per column, and tasks sort their share of the rows, which may spill. The counted
    column leads the sort: its values tell rows apart, while the few keys of a task tie nearly all of them.
    """
    out = dealt(rows, rows.count(), *keys)
    for mark, col in marks.items():
        place = F.row_number().over(Window.partitionBy(col, *keys).orderBy(col))
        out = out.withColumn(mark, F.when(F.col(col).isNotNull() & (place == 1), True))
    return out


def reviews_panel(
    reviews: DataFrame, min_reviews: int = 10, grain: str = "month", text_key: str = "Text"
) -> DataFrame:
    """Clean reviews summarised per product and period."""
    spec = specs.REVIEWS
    clean = cleaning.clean_reviews(reviews.select("ProductId", "UserId", text_key, "Time", "Score"), text_key)
    moment = S.timestamp_from_unix(F.col("Time"))
    rows = stored(clean.select(
        "ProductId", "UserId", "Score", moment.alias("review_date"), S.period_start(moment, grain).alias("month"),
    ), "clean-reviews")
    marked = with_distinct(rows, ["ProductId", "month"], {"_user": "UserId"})
    scored = marked.withColumn("sentiment_score", S.rating_sentiment(F.col("Score")))
    agg = scored.groupBy("ProductId", "month").agg(
        F.avg("sentiment_score").alias("sentiment_mean"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"),
        F.count("sentiment_score").alias("review_count"),
        F.min("Score").alias("score_min"),
        F.max("Score").alias("score_max"),
        S.median_rating(scored, "Score").alias("score_median"),
        F.count("_user").alias("unique_reviewers"),
        F.min("review_date").alias("_first_in_period"),
        F.count("*").alias("_rows"),
    )
    total = F.sum("_rows").over(Window.partitionBy(spec.id_col))
    return _with_history(agg, spec, total >= min_reviews).drop("_rows")


def sales_panel(sales: DataFrame, min_periods: int = 6, grain: str = "month") -> DataFrame:
    """Clean invoice lines summarised per product and period."""
    spec = specs.SALES
    clean = cleaning.clean_sales(sales)
    rows = clean.select(
        "StockCode", "Invoice", "CustomerID", "Quantity", "Price", "InvoiceDate", S.period_start(F.col("InvoiceDate"), grain).alias("month"),
    )
    marked = with_distinct(rows, ["StockCode", "month"], {"_customer": "CustomerID", "_order": "Invoice"})
    agg = marked.withColumn("Revenue", F.col("Quantity") * F.col("Price")).groupBy("StockCode", "month").agg(
        F.sum("Revenue").alias("revenue_total"),
        F.avg("Revenue").alias("revenue_mean"),
        F.coalesce(F.stddev_samp("Revenue"), F.lit(0.0)).alias("revenue_std"),
        F.count("Revenue").alias("transaction_count"),
        F.sum("Quantity").alias("quantity_sold"),
        F.count("_customer").alias("unique_customers"),
        F.count("_order").alias("unique_orders"),
        F.avg("Price").alias("avg_price"),
        F.min("InvoiceDate").alias("_first_in_period"),
    )
    periods = F.count("*").over(Window.partitionBy(spec.id_col))
    return _with_history(agg, spec, periods >= min_periods)


def usage_panel(
    events: DataFrame, min_events: int = 50, grain: str = "month"
) -> DataFrame:
    """Clean events summarised per product and period."""
    clean = cleaning.clean_events(events)
    rows = clean.withColumn("month", S.period_start(F.col("event_time"), grain))
    agg = usage_aggregates(rows)
    spec = specs.USAGE
    total = F.sum("event_count").over(Window.partitionBy(spec.id_col))
    return _with_history(agg, spec, total >= min_events)


def usage_aggregates(rows: DataFrame) -> DataFrame:
    weight = S.event_weight(F.col("event_type"))
    scored = rows.withColumn("engagement_score", weight)
    return scored.groupBy("product_id", "month").agg(
        F.sum("engagement_score").alias("engagement_total"),
        F.avg("engagement_score").alias("engagement_mean"),
        F.count("engagement_score").alias("event_count"),
        F.countDistinct("user_id").alias("active_users"),
        F.count_if(F.col("event_type") == "view").alias("view_count"),
        F.count_if(F.col("event_type") == "cart").alias("cart_count"),
        F.count_if(F.col("event_type") == "purchase").alias("purchase_count"),
        F.avg("price").alias("avg_price"),
        F.countDistinct("user_session").alias("unique_sessions"),
        F.min("event_time").alias("_first_in_period"),
    )
