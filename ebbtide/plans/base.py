"""Query registry, table access and the SQL fragments the oracles are built from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbtide import specs
from ebbtide.operators import labels, panel, signals
from ebbtide.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_BODIES: dict[str, str] = {}


class Tables:
    """The input tables of one directory and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # raw logs
    def sales_log(self, grain: str = "part") -> DataFrame:
        part = self["part"] if grain == "brand" else None
        return adapters.sales_log(self["lineitem"], self["orders"], part)

    def reviews_log(self, grain: str = "part") -> DataFrame:
        part = self["part"] if grain == "brand" else None
        return adapters.reviews_log(self["lineitem"], self["orders"], self["documents"], part)

    def usage_log(self) -> DataFrame:
        return adapters.usage_log(self["events"])

    # panels with signals
    def sales(self, grain: str = "part") -> DataFrame:
        return signals.sales_signals(panel.sales_panel(self.sales_log(grain)))

    def reviews(self, grain: str = "part") -> DataFrame:
        log = self.reviews_log(grain)
        return signals.reviews_signals(panel.reviews_panel(log, text_key="TextKey"))

    def usage(self) -> DataFrame:
        """Weekly: the events cover a single month."""
        return signals.usage_signals(panel.usage_panel(self.usage_log(), grain="week"))

    def signals(self, source: str, grain: str = "part") -> DataFrame:
        if source == "sales":
            return self.sales(grain)
        if source == "reviews":
            return self.reviews(grain)
        return self.usage()

    def labelled(self, source: str, grain: str = "part") -> DataFrame:
        return labels.with_label(self.signals(source, grain), specs.SOURCES[source])


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is a SQL body that may use the named fragments below."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE_BODIES[name] = oracle
        return fn

    return register


# --------------------------------------------------------------------------- SQL fragments

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    if name in FRAGMENTS:
        raise ValueError(f"duplicate fragment {name}")
    FRAGMENTS[name] = sql


def compose(body: str) -> str:
    """Prefix the body with the fragments it uses, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in FRAGMENTS and word not in ordered:
                visit(FRAGMENTS[word])
                if word not in ordered:
                    ordered.append(word)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS (\n{FRAGMENTS[n].strip()}\n)" for n in ordered)
    return f"WITH {ctes}\n{body.strip()}"


def r6(expr: str, digits: int = 6) -> str:
    """Double rounded half away from zero by way of nine decimal digits, as ``rounded`` does."""
    return f"round(({expr})::DECIMAL(38,9), {digits})::DOUBLE"


def sql_bucket(key: str, buckets: int = 1_000_000) -> str:
    return f"((('0x' || substr(md5(({key})::VARCHAR), 1, 8))::UBIGINT % {buckets})::BIGINT)"


def sql_pct(x: str, w: str) -> str:
    lag = f"nullif(lag({x}) OVER {w}, 0)"
    return f"(({x})::DOUBLE / {lag} - 1) * 100"


def sql_stage(age: str, bounds) -> str:
    a, b, c = bounds
    return (
        f"CASE WHEN {age} < {a} THEN 'introduction' WHEN {age} < {b} THEN 'growth' "
        f"WHEN {age} < {c} THEN 'maturity' ELSE 'decline' END"
    )


def sql_age(period: str, first: str) -> str:
    return f"round(floor((epoch({period}::TIMESTAMP) - epoch({first})) / 86400) / 30.0, 1)"


def _sales(p: str, product: str, join: str) -> None:
    fragment(f"{p}_log", f"""
SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey::VARCHAR AS "Invoice",
       {product} AS "StockCode", l_quantity AS "Quantity", o_orderdate AS "InvoiceDate",
       l_extendedprice / nullif(l_quantity, 0) AS "Price", o_custkey AS "CustomerID"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey {join}""")
    fragment(f"{p}_valid", f"""
SELECT * FROM {p}_log WHERE "CustomerID" IS NOT NULL AND NOT starts_with("Invoice", 'C')
  AND "Quantity" > 0 AND "Price" > 0""")
    fragment(f"{p}_quantity_cut", f"""
SELECT * FROM {p}_valid
WHERE "Quantity" < (SELECT quantile_cont("Quantity", 0.999) FROM {p}_valid)""")
    fragment(f"{p}_clean", f"""
SELECT *, "Quantity" * "Price" AS "Revenue", date_trunc('month', "InvoiceDate")::DATE AS month
FROM {p}_quantity_cut
WHERE "Price" < (SELECT quantile_cont("Price", 0.999) FROM {p}_quantity_cut)""")
    fragment(f"{p}_agg", f"""
SELECT "StockCode", month, sum("Revenue") AS revenue_total, avg("Revenue") AS revenue_mean,
       coalesce(stddev_samp("Revenue"), 0.0) AS revenue_std,
       count("Revenue") AS transaction_count, sum("Quantity") AS quantity_sold,
       count(DISTINCT "CustomerID") AS unique_customers,
       count(DISTINCT "Invoice") AS unique_orders, avg("Price") AS avg_price
FROM {p}_clean GROUP BY ALL""")
    fragment(f"{p}_first", f"""
SELECT "StockCode", min("InvoiceDate") AS first_sale_date, count(DISTINCT month) AS n_months
FROM {p}_clean GROUP BY ALL HAVING count(DISTINCT month) >= 6""")
    fragment(f"{p}_aged", f"""
SELECT a.*, f.first_sale_date, {sql_age('a.month', 'f.first_sale_date')} AS product_age_months
FROM {p}_agg a JOIN {p}_first f USING ("StockCode")""")
    w = '(PARTITION BY "StockCode" ORDER BY month)'
    roll = '(PARTITION BY "StockCode" ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)'
    fragment(f"{p}_velocity", f"""
SELECT *, {sql_stage('product_age_months', (3, 12, 24))} AS lifecycle_stage,
       revenue_total / nullif(unique_orders, 0) AS aov,
       {sql_pct('revenue_total', w)} AS revenue_velocity,
       {sql_pct('unique_customers', w)} AS customer_churn_rate,
       stddev_samp(revenue_total) OVER {roll} AS revenue_volatility,
       {sql_pct('unique_orders', w)} AS order_frequency_change,
       {sql_pct('revenue_total / nullif(unique_orders, 0)', w)} AS aov_change,
       unique_customers::DOUBLE / nullif(transaction_count, 0) AS customer_concentration
FROM {p}_aged""")
    fragment(f"{p}_signals", f"""
SELECT *, revenue_velocity - lag(revenue_velocity) OVER {w} AS revenue_acceleration
FROM {p}_velocity""")
    fragment(f"{p}_panel", f"""
SELECT *, CASE
  WHEN coalesce(revenue_velocity, 0) < -20 AND coalesce(customer_churn_rate, 0) < -15
       AND coalesce(revenue_acceleration, 0) < -10 THEN 'high_fatigue'
  WHEN coalesce(revenue_velocity, 0) < -10
       OR (coalesce(customer_churn_rate, 0) < -10
           AND coalesce(revenue_volatility, 0) > revenue_total * 0.5) THEN 'moderate_fatigue'
  ELSE 'healthy' END AS fatigue_label
FROM {p}_signals""")


_sales("sales", "l_partkey::VARCHAR", "")
_sales("brand_sales", "p_brand", "JOIN part ON l_partkey = p_partkey")


def _reviews(p: str, product: str, join: str) -> None:
    fragment(f"{p}_log", f"""
SELECT {product} AS "ProductId", o_custkey::VARCHAR AS "UserId",
       try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS "Score",
       epoch(o_orderdate)::BIGINT AS "Time",
       substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS "Summary",
       doc_id, sha256(text) AS "TextKey"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey {join}
JOIN documents ON doc_id = l_orderkey % (SELECT count(*) FROM documents)""")
    fragment(f"{p}_ranked", f"""
SELECT *, row_number() OVER (PARTITION BY "ProductId", "UserId", "TextKey"
                             ORDER BY "Time", "Score", "Summary", doc_id) AS copy_rank
FROM {p}_log WHERE "TextKey" IS NOT NULL AND "Score" BETWEEN 1 AND 5""")
    fragment(f"{p}_clean", f"""
SELECT * EXCLUDE (copy_rank), make_timestamp("Time" * 1000000) AS review_date,
       date_trunc('month', make_timestamp("Time" * 1000000))::DATE AS month,
       CASE "Score" WHEN 1 THEN -1.0 WHEN 2 THEN -0.5 WHEN 3 THEN 0.0 WHEN 4 THEN 0.5
                    WHEN 5 THEN 1.0 END::DOUBLE AS sentiment_score
FROM {p}_ranked WHERE copy_rank = 1""")
    fragment(f"{p}_first", f"""
SELECT "ProductId", min(review_date) AS first_review_date
FROM {p}_clean GROUP BY ALL HAVING count(*) >= 10""")
    fragment(f"{p}_agg", f"""
SELECT "ProductId", month, avg(sentiment_score) AS sentiment_mean,
       stddev_samp(sentiment_score) AS sentiment_std, count(sentiment_score) AS review_count,
       min("Score") AS score_min, max("Score") AS score_max,
       quantile_cont("Score", 0.5) AS score_median, count(DISTINCT "UserId") AS unique_reviewers
FROM {p}_clean GROUP BY ALL""")
    fragment(f"{p}_aged", f"""
SELECT a.*, f.first_review_date,
       {sql_age('a.month', 'f.first_review_date')} AS product_age_months
FROM {p}_agg a JOIN {p}_first f USING ("ProductId")""")
    w = '(PARTITION BY "ProductId" ORDER BY month)'
    roll = '(PARTITION BY "ProductId" ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)'
    fragment(f"{p}_velocity", f"""
SELECT *, {sql_stage('product_age_months', (3, 12, 24))} AS lifecycle_stage,
       sentiment_mean - lag(sentiment_mean) OVER {w} AS sentiment_velocity,
       stddev_samp(sentiment_mean) OVER {roll} AS sentiment_volatility,
       {sql_pct('review_count', w)} AS review_momentum,
       score_max - score_min AS sentiment_polarization,
       {sql_pct('unique_reviewers', w)} AS reviewer_diversity_change
FROM {p}_aged""")
    fragment(f"{p}_signals", f"""
SELECT *, sentiment_velocity - lag(sentiment_velocity) OVER {w} AS sentiment_acceleration
FROM {p}_velocity""")
    fragment(f"{p}_panel", f"""
SELECT *, CASE
  WHEN sentiment_mean < -0.2 AND coalesce(sentiment_velocity, 0) < -0.15
       AND coalesce(sentiment_acceleration, 0) < -0.05 AND coalesce(review_momentum, 0) < -20
    THEN 'high_fatigue'
  WHEN (sentiment_mean < 0 AND coalesce(sentiment_velocity, 0) < -0.05)
       OR (coalesce(review_momentum, 0) < -15 AND coalesce(sentiment_volatility, 0) > 0.3)
    THEN 'moderate_fatigue'
  ELSE 'healthy' END AS fatigue_label
FROM {p}_signals""")


_reviews("reviews", "l_partkey::VARCHAR", "")
_reviews("brand_reviews", "p_brand", "JOIN part ON l_partkey = p_partkey")

fragment("usage_log", """
SELECT ts AS event_time, CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
       try_cast(json_extract_string(props, '$.k') AS INTEGER) AS product_id, value AS price, user_id,
       user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS user_session
FROM events""")
fragment("usage_valid", """
SELECT * FROM usage_log WHERE product_id IS NOT NULL AND user_id IS NOT NULL
  AND event_type IN ('view', 'cart', 'purchase') AND price > 0""")
fragment("usage_clean", """
SELECT *, date_trunc('week', event_time)::DATE AS month,
       CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 5 WHEN 'purchase' THEN 15 END AS engagement_score
FROM usage_valid WHERE price < (SELECT quantile_cont(price, 0.999) FROM usage_valid)""")
fragment("usage_first", """
SELECT product_id, min(event_time) AS first_event_date
FROM usage_clean GROUP BY ALL HAVING count(*) >= 50""")
fragment("usage_agg", """
SELECT product_id, month, sum(engagement_score)::BIGINT AS engagement_total,
       avg(engagement_score) AS engagement_mean, count(engagement_score) AS event_count,
       count(DISTINCT user_id) AS active_users,
       count(*) FILTER (event_type = 'view') AS view_count,
       count(*) FILTER (event_type = 'cart') AS cart_count,
       count(*) FILTER (event_type = 'purchase') AS purchase_count,
       avg(price) AS avg_price, count(DISTINCT user_session) AS unique_sessions
FROM usage_clean GROUP BY ALL""")
fragment("usage_aged", f"""
SELECT a.*, f.first_event_date, {sql_age('a.month', 'f.first_event_date')} AS product_age_months,
       100.0::DOUBLE * (a.cart_count::DOUBLE / nullif(a.view_count, 0)) AS view_to_cart_rate,
       100.0::DOUBLE * (a.purchase_count::DOUBLE / nullif(a.cart_count, 0)) AS cart_to_purchase_rate,
       100.0::DOUBLE * (a.purchase_count::DOUBLE / nullif(a.event_count, 0)) AS conversion_rate,
       100.0::DOUBLE * (a.purchase_count::DOUBLE / nullif(a.view_count, 0)) AS funnel_efficiency,
       a.engagement_total::DOUBLE / nullif(a.unique_sessions, 0) AS engagement_per_session
FROM usage_agg a JOIN usage_first f USING (product_id)""")
_W = "(PARTITION BY product_id ORDER BY month)"
_ROLL = "(PARTITION BY product_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
fragment("usage_velocity", f"""
SELECT *, {sql_stage('product_age_months', (1, 3, 6))} AS lifecycle_stage,
       {sql_pct('engagement_total', _W)} AS engagement_velocity,
       {sql_pct('active_users', _W)} AS user_retention_rate,
       {sql_pct('unique_sessions', _W)} AS session_frequency_change,
       conversion_rate - lag(conversion_rate) OVER {_W} AS conversion_rate_change,
       stddev_samp(engagement_total) OVER {_ROLL} AS engagement_volatility,
       {sql_pct('purchase_count', _W)} AS purchase_momentum,
       funnel_efficiency - lag(funnel_efficiency) OVER {_W} AS funnel_efficiency_change,
       {sql_pct('engagement_per_session', _W)} AS engagement_quality_change
FROM usage_aged""")
fragment("usage_signals", f"""
SELECT *, engagement_velocity - lag(engagement_velocity) OVER {_W} AS engagement_acceleration
FROM usage_velocity""")
fragment("usage_panel", """
SELECT *, CASE
  WHEN coalesce(engagement_velocity, 0) < -25 AND coalesce(user_retention_rate, 0) < -20
       AND coalesce(purchase_momentum, 0) < -30 AND coalesce(engagement_acceleration, 0) < -15
    THEN 'high_fatigue'
  WHEN (coalesce(engagement_velocity, 0) < -15 AND coalesce(user_retention_rate, 0) < -10)
       OR (coalesce(conversion_rate_change, 0) < -2 AND coalesce(purchase_momentum, 0) < -15)
       OR (coalesce(engagement_velocity, 0) < -20 AND conversion_rate < 2)
    THEN 'moderate_fatigue'
  ELSE 'healthy' END AS fatigue_label
FROM usage_signals""")
