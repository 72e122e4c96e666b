"""Row filters and scalar projections over the raw logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.functions import text as X
from ebbtide.operators import cleaning, history, validation
from ebbtide.operators.embeddings import document_statistics
from ebbtide.plans.base import Tables, fragment, query, r6, sql_bucket
from ebbtide.plans.panels import ID_TIME
from ebbtide.plans.shape import names, portable, rounded, sql_cols

# ----------------------------------------------------------------- reviews filters


@query("f1_reviews_with_text", """
SELECT "Score"::BIGINT AS "Score", count(*) AS n_rows FROM reviews_log
WHERE "TextKey" IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    df = cleaning.drop_missing_text(t.reviews_log(), "TextKey")
    return portable(df.groupBy("Score").agg(F.count("*").alias("n_rows")))


@query("f2_valid_scores", """
SELECT "ProductId", count(*) AS n_rows FROM reviews_log
WHERE "Score" BETWEEN 1 AND 5 GROUP BY ALL""")
def _(t: Tables):
    return cleaning.valid_scores(t.reviews_log()).groupBy("ProductId").agg(
        F.count("*").alias("n_rows")
    )


@query("f3_first_of_duplicate_reviews", """
SELECT "ProductId", "UserId", doc_id::BIGINT AS doc_id, "Time"::BIGINT AS "Time", "Score"::BIGINT AS "Score"
FROM reviews_ranked WHERE copy_rank = 1""")
def _(t: Tables):
    df = cleaning.clean_reviews(t.reviews_log(), "TextKey")
    return portable(df, ["ProductId", "UserId", "doc_id", "Time", "Score"])


@query("f4_products_with_reviews", """
SELECT "ProductId", count(*) AS n_rows, sum("Time")::BIGINT AS time_total FROM reviews_log
GROUP BY ALL HAVING count(*) >= 30""")
def _(t: Tables):
    df = cleaning.products_with_rows(t.reviews_log(), "ProductId", 30)
    return df.groupBy("ProductId").agg(
        F.count("*").alias("n_rows"), F.sum("Time").alias("time_total")
    )


# ----------------------------------------------------------------- sales filters


def _sales_rows(df):
    return df.groupBy("StockCode").agg(
        F.count("*").alias("n_rows"),
        rounded(F.sum("Quantity"), 4).alias("quantity"),
        rounded(F.max("Price")).alias("top_price"),
    )


_SALES_ROWS = (
    f'SELECT "StockCode", count(*) AS n_rows, {r6("sum(\"Quantity\")", 4)} AS quantity, '
    f'{r6("max(\"Price\")")} AS top_price FROM '
)


@query("f5_known_customer", _SALES_ROWS + 'sales_log WHERE "CustomerID" IS NOT NULL GROUP BY ALL')
def _(t: Tables):
    return _sales_rows(t.sales_log().where(F.col("CustomerID").isNotNull()))


@query("f6_not_cancelled", _SALES_ROWS + "sales_log WHERE NOT starts_with(\"Invoice\", 'C') GROUP BY ALL")
def _(t: Tables):
    return _sales_rows(t.sales_log().where(~F.col("Invoice").startswith("C")))


@query("f7_positive_quantity_price", _SALES_ROWS + "sales_valid GROUP BY ALL")
def _(t: Tables):
    return _sales_rows(cleaning.valid_sales(t.sales_log()))


@query("f8_quantile_outlier_cut", _SALES_ROWS + "sales_clean GROUP BY ALL")
def _(t: Tables):
    return _sales_rows(cleaning.clean_sales(t.sales_log()))


@query("f9_products_with_periods", _SALES_ROWS + """sales_valid WHERE "StockCode" IN (
  SELECT "StockCode" FROM sales_valid GROUP BY ALL
  HAVING count(DISTINCT date_trunc('month', "InvoiceDate")) >= 18) GROUP BY ALL""")
def _(t: Tables):
    df = cleaning.valid_sales(t.sales_log()).withColumn(
        "month", S.period_start(F.col("InvoiceDate"))
    )
    return _sales_rows(cleaning.products_with_periods(df, "StockCode", "month", 18))


# ----------------------------------------------------------------- usage filters


def _event_rows(df):
    return df.groupBy("product_id", "event_type").agg(
        F.count("*").alias("n_rows"), rounded(F.max("price")).alias("top_price")
    ).select(F.col("product_id").cast("bigint"), "event_type", "n_rows", "top_price")


_EVENT_ROWS = (
    f"SELECT product_id::BIGINT AS product_id, event_type, count(*) AS n_rows, "
    f"{r6('max(price)')} AS top_price FROM "
)


@query("f10_known_product_and_user", _EVENT_ROWS + "usage_log WHERE product_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    return _event_rows(t.usage_log().dropna(subset=["product_id", "user_id"]))


@query("f11_funnel_events", _EVENT_ROWS + "usage_valid GROUP BY ALL")
def _(t: Tables):
    return _event_rows(cleaning.valid_events(t.usage_log()))


@query("f12_products_with_events", _EVENT_ROWS + """usage_clean WHERE product_id IN (
  SELECT product_id FROM usage_clean GROUP BY ALL HAVING count(*) >= 50) GROUP BY ALL""")
def _(t: Tables):
    df = cleaning.clean_events(t.usage_log())
    return _event_rows(cleaning.products_with_rows(df, "product_id", 50))


@query("f16_subgroups_of_minimum_size", """
SELECT lifecycle_stage, fatigue_label, count(*) AS n_rows FROM usage_panel
GROUP BY ALL HAVING count(*) >= 10""")
def _(t: Tables):
    return (
        t.labelled("usage").groupBy("lifecycle_stage", "fatigue_label")
        .agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= 10)
    )


def _violations_sql(source: str) -> str:
    parts = [
        f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}' END"
        for c, (lo, hi) in validation.INPUT_RANGES[source].items()
    ]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


def _register_validation(source: str, frag: str, product: str) -> None:
    viol = _violations_sql(source)

    @query(f"f17_input_ranges_{source}", f"""
SELECT "{product}"::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month,
       {viol} AS violations, ({viol}) = '' AS accepted FROM {frag}""")
    def _(t: Tables):
        spec = specs.SOURCES[source]
        df = history.history_features(t.signals(source), spec)
        out = validation.validate(df, validation.INPUT_RANGES[source])
        return portable(out.select(
            F.col(spec.id_col).cast("string").alias("product"), "month",
            F.array_join("violations", ",").alias("violations"), "accepted",
        ))


_register_validation("sales", "sales_signals", "StockCode")
_register_validation("reviews", "reviews_signals", "ProductId")
fragment("usage_quality", """
SELECT *, (engagement_per_session - lag(engagement_per_session) OVER w)
  / nullif(lag(engagement_per_session) OVER w, 0) * 100 AS safe_engagement_quality_change
FROM usage_signals WINDOW w AS (PARTITION BY product_id ORDER BY month)""")
_register_validation("usage", "usage_quality", "product_id")

# ----------------------------------------------------------------- projections P1..P6


@query("p1_unix_to_timestamp", """
SELECT "Time"::BIGINT AS "Time", strftime(make_timestamp("Time" * 1000000), '%Y-%m-%d %H:%M:%S') AS moment,
       count(*) AS n_rows FROM reviews_log GROUP BY ALL""")
def _(t: Tables):
    df = t.reviews_log().groupBy("Time").agg(F.count("*").alias("n_rows"))
    moment = S.timestamp_from_unix(F.col("Time"))
    return portable(df.withColumn("moment", moment), ["Time", "moment", "n_rows"])


@query("p2_calendar_fields", """
SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, year(ts)::BIGINT AS year,
       strftime(ts, '%Y-%m') AS year_month, strftime(ts, '%Y-%m-%d') AS date,
       hour(ts)::BIGINT AS hour, (isodow(ts) - 1)::BIGINT AS day_of_week, dayname(ts) AS day_name
FROM events""")
def _(t: Tables):
    ts = F.col("ts")
    return portable(t["events"].select(
        "event_id",
        S.period_start(ts).alias("month"),
        F.year(ts).alias("year"),
        F.date_format(ts, "yyyy-MM").alias("year_month"),
        F.to_date(ts).alias("date"),
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        F.date_format(ts, "EEEE").alias("day_name"),
    ))


@query("p3_naive_timestamp", """
SELECT event_id, CASE WHEN event_type <> 'error'
  THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS moment FROM events""")
def _(t: Tables):
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), shown)).otherwise(
        F.concat(shown, F.lit(" UTC"))
    )
    return portable(t["events"].select("event_id", S.naive_timestamp(raw).alias("moment")))


@query("p4_rating_sentiment", """
SELECT "ProductId", sum(CASE "Score" WHEN 1 THEN -1.0 WHEN 2 THEN -0.5 WHEN 3 THEN 0.0
  WHEN 4 THEN 0.5 WHEN 5 THEN 1.0 END)::DOUBLE AS sentiment FROM reviews_log GROUP BY ALL""")
def _(t: Tables):
    return t.reviews_log().groupBy("ProductId").agg(
        F.sum(S.rating_sentiment(F.col("Score"))).alias("sentiment")
    )


@query("p5_line_revenue", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
       {r6('l_quantity * (l_extendedprice / nullif(l_quantity, 0))')} AS revenue FROM lineitem""")
def _(t: Tables):
    price = S.ratio(F.col("l_extendedprice"), F.col("l_quantity"))
    return portable(t["lineitem"].select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * price).alias("revenue")
    ))


@query("p6_event_weight", """
SELECT product_id::BIGINT AS product_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 5
  WHEN 'purchase' THEN 15 END)::BIGINT AS engagement FROM usage_log GROUP BY ALL""")
def _(t: Tables):
    return t.usage_log().groupBy("product_id").agg(
        F.sum(S.event_weight(F.col("event_type"))).alias("engagement")
    ).select(F.col("product_id").cast("bigint"), "engagement")


# ----------------------------------------------------------------- projections P13..P18

_DERIVED = {
    "sales": (
        "d:revenue_per_transaction d:quantity_per_transaction d:revenue_x_concentration d:aov_x_freq_change",
        """SELECT *, revenue_total / nullif(transaction_count, 0) AS revenue_per_transaction,
        quantity_sold / nullif(transaction_count, 0) AS quantity_per_transaction,
        revenue_total * customer_concentration AS revenue_x_concentration,
        aov_change * order_frequency_change AS aov_x_freq_change FROM sales_signals""",
    ),
    "reviews": (
        "d:sentiment_x_volume d:volatility_x_volume",
        """SELECT *, sentiment_mean * review_count AS sentiment_x_volume,
        sentiment_std * review_count AS volatility_x_volume FROM reviews_signals""",
    ),
    "usage": (
        "d:engagement_x_conversion d:full_funnel_rate",
        """SELECT *, engagement_total * conversion_rate AS engagement_x_conversion,
        view_to_cart_rate * cart_to_purchase_rate AS full_funnel_rate FROM usage_signals""",
    ),
}


def _register_derived(name: str, source: str, cols: str) -> None:
    wanted = f"{ID_TIME[source]} {cols}"

    @query(name, f"SELECT {sql_cols(wanted)} FROM {source}_derived")
    def _(t: Tables):
        return portable(
            history.derived_features(t.signals(source), specs.SOURCES[source]), names(wanted)
        )


for _s, (_cols, _sql) in _DERIVED.items():
    fragment(f"{_s}_derived", _sql)
    _split = 2 if _s == "sales" else 0
    if _split:
        _register_derived("p13_per_transaction_features", _s, " ".join(_cols.split()[:_split]))
    _register_derived(f"p14_interactions_{_s}", _s, " ".join(_cols.split()[_split:]))


@query("p15_log_difference", f"""
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, {r6('''
  CASE WHEN lag(revenue_total) OVER w IS NOT NULL
  THEN ln(1 + greatest(revenue_total, 0)) - ln(1 + greatest(lag(revenue_total) OVER w, 0)) END''')} AS log_diff
FROM sales_aged WINDOW w AS (PARTITION BY "StockCode" ORDER BY month)""")
def _(t: Tables):
    w = Window.partitionBy("StockCode").orderBy("month")
    revenue = F.col("revenue_total")
    return portable(t.sales().select(
        "StockCode", "month", S.log_difference(revenue, F.lag(revenue).over(w)).alias("log_diff")
    ))


@query("p16_epsilon_ratio", f"""
SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month,
       {r6('purchase_count / (event_count + 1e-6)')} AS safe_share FROM usage_aged""")
def _(t: Tables):
    share = S.epsilon_ratio(F.col("purchase_count"), F.col("event_count"))
    return portable(t.usage().select("product_id", "month", share.alias("safe_share")))


@query("p17_non_finite_to_null", f"""
SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month,
       {r6('purchase_momentum')} AS momentum, {r6('conversion_rate_change')} AS change FROM usage_signals""")
def _(t: Tables):
    w = Window.partitionBy("product_id").orderBy("month")
    previous = F.lag("purchase_count").over(w)
    raw = F.when(previous == 0, F.lit(float("inf"))).otherwise(F.col("purchase_momentum"))
    df = t.usage().select(
        "product_id", "month", raw.alias("momentum"),
        F.coalesce(F.col("conversion_rate_change"), F.lit(float("nan"))).alias("change"),
    )
    return portable(S.nullify_non_finite(df))


@query("p18_leakage_safe_columns", f"""
SELECT {sql_cols("d:revenue_total d:revenue_mean d:revenue_std i:transaction_count d:quantity_sold "
                 "i:unique_customers i:unique_orders d:avg_price d:product_age_months s:lifecycle_stage "
                 "d:aov d:revenue_velocity d:order_frequency_change d:aov_change d:customer_concentration")}
FROM sales_panel""")
def _(t: Tables):
    from ebbtide.operators.prep import drop_leaky_columns

    return portable(drop_leaky_columns(t.labelled("sales")))


# ----------------------------------------------------------------- projections P20..P24

fragment("document_words", rf"""
SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '{X.WHITESPACE}'), lambda w: w <> '') AS tokens
FROM documents""")
_COMPLAINTS = ", ".join(f"'{w}'" for w in specs.COMPLAINT_WORDS)
fragment("document_features", rf"""
SELECT doc_id, length(text) AS review_length, greatest(len(tokens), 1) AS word_count,
       len(list_distinct(tokens))::DOUBLE / greatest(len(tokens), 1) AS lexical_diversity,
       len(list_filter(tokens, lambda w: w IN ({_COMPLAINTS}))) AS complaint_keyword_count,
       length(text) - length(replace(text, '?', '')) AS question_count,
       length(text) - length(replace(text, '!', '')) AS exclamation_count,
       length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS caps_ratio
FROM document_words""")
TEXT_COLS = (
    "i:review_length i:word_count d:lexical_diversity i:complaint_keyword_count i:question_count "
    "i:exclamation_count d:caps_ratio"
)


@query("p20_text_statistics", f"SELECT {sql_cols('i:doc_id ' + TEXT_COLS)} FROM document_features")
def _(t: Tables):
    return portable(document_statistics(t["documents"]))


@query("p21_composed_text", """
SELECT doc_id, substr(CASE WHEN source <> '' THEN source || '. ' || text ELSE text END, 1, 512) AS composed
FROM documents""")
def _(t: Tables):
    return t["documents"].select("doc_id", X.compose(F.col("source"), F.col("text")).alias("composed"))


@query("p22_json_fields", """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
       '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS encoded
FROM events""")
def _(t: Tables):
    parsed = F.from_json("props", "k int")
    return t["events"].select(
        "event_id", parsed.getField("k").cast("bigint").alias("k"),
        F.to_json(F.struct("event_type", parsed.getField("k").alias("k"))).alias("encoded"),
    )


@query("p23_what_if_projection", f"""
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, {r6('revenue_total * (1.0::DOUBLE + -25.0 / 100.0)', 4)} AS revenue_total
FROM sales_aged""")
def _(t: Tables):
    df = validation.what_if(t.sales(), "revenue_total", -25.0)
    return portable(df, ["StockCode", "month", "revenue_total"], digits=4)


@query("p24_augmented_inputs", f"""
SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month,
       CASE WHEN product_age_months < 3 THEN 'introduction' WHEN product_age_months < 12 THEN 'growth'
            WHEN product_age_months < 24 THEN 'maturity' ELSE 'decline' END AS lifecycle_stage,
       {r6('engagement_total::DOUBLE / nullif(unique_sessions, 0)')} AS engagement_per_session
FROM usage_aged""")
def _(t: Tables):
    given = t.usage().drop("lifecycle_stage").withColumn(
        "engagement_per_session",
        F.when(S.hash_bucket(F.col("product_id"), 2) == 0, F.col("engagement_per_session")),
    )
    out = validation.augment(given, "usage")
    return portable(out, ["product_id", "month", "lifecycle_stage", "engagement_per_session"])


# ----------------------------------------------------------------- sampling


@query("i1_hash_sample", f"""
SELECT event_id, event_type FROM events WHERE {sql_bucket('event_id', 1000)} < 100""")
def _(t: Tables):
    from ebbtide.operators.sampling import hash_sample

    return hash_sample(t["events"], "event_id", 0.10).select("event_id", "event_type")


@query("t7_capped_sample", f"""
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month FROM sales_aged
ORDER BY {sql_bucket('"StockCode" || \'|\' || strftime(month, \'%Y-%m-%d\')', 4294967296)}, "StockCode", month LIMIT 5000""")
def _(t: Tables):
    from ebbtide.operators.sampling import capped_sample

    df = portable(t.sales().select("StockCode", "month"))
    return capped_sample(df, ["StockCode", "month"], 5000)
