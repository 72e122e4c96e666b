"""Panels, signals, labels and row filters of the three sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators import cleaning, labels, panel, signals
from ebbtide.plans.base import Tables, fragment, query, r6
from ebbtide.plans.shape import names, portable, rounded, sql_cols

SALES_BASE = (
    "s:StockCode t:month d:revenue_total d:revenue_mean d:revenue_std i:transaction_count "
    "d:quantity_sold i:unique_customers i:unique_orders d:avg_price"
)
SALES_AGE = "m:first_sale_date d:product_age_months s:lifecycle_stage"
SALES_SIGNALS = (
    "d:revenue_velocity d:revenue_acceleration d:customer_churn_rate d:revenue_volatility "
    "d:order_frequency_change d:aov d:aov_change d:customer_concentration"
)
REVIEWS_BASE = (
    "s:ProductId t:month d:sentiment_mean d:sentiment_std i:review_count i:score_min i:score_max "
    "d:score_median i:unique_reviewers"
)
REVIEWS_AGE = "m:first_review_date d:product_age_months s:lifecycle_stage"
REVIEWS_SIGNALS = (
    "d:sentiment_velocity d:sentiment_acceleration d:sentiment_volatility d:review_momentum "
    "i:sentiment_polarization d:reviewer_diversity_change"
)
USAGE_BASE = (
    "i:product_id t:month i:engagement_total d:engagement_mean i:event_count i:active_users "
    "i:view_count i:cart_count i:purchase_count d:avg_price i:unique_sessions"
)
USAGE_AGE = "m:first_event_date d:product_age_months s:lifecycle_stage"
USAGE_SIGNALS = (
    "d:view_to_cart_rate d:cart_to_purchase_rate d:conversion_rate d:engagement_velocity "
    "d:engagement_acceleration d:user_retention_rate d:session_frequency_change "
    "d:conversion_rate_change d:engagement_volatility d:purchase_momentum d:funnel_efficiency "
    "d:funnel_efficiency_change d:engagement_per_session d:engagement_quality_change"
)
FULL = {
    "sales": f"{SALES_BASE} {SALES_AGE} {SALES_SIGNALS} s:fatigue_label",
    "reviews": f"{REVIEWS_BASE} {REVIEWS_AGE} {REVIEWS_SIGNALS} s:fatigue_label",
    "usage": f"{USAGE_BASE} {USAGE_AGE} {USAGE_SIGNALS} s:fatigue_label",
}
ID_TIME = {
    "sales": "s:StockCode t:month", "reviews": "s:ProductId t:month", "usage": "i:product_id t:month",
}


def register_labelled(name: str, source: str, grain: str, frag: str) -> None:
    cols = FULL[source]

    @query(name, f"SELECT {sql_cols(cols)} FROM {frag}")
    def _(t: Tables):
        return portable(t.labelled(source, grain), names(cols))


register_labelled("sales_panel_labeled", "sales", "part", "sales_panel")
register_labelled("sales_brand_panel_labeled", "sales", "brand", "brand_sales_panel")
register_labelled("reviews_panel_labeled", "reviews", "part", "reviews_panel")
register_labelled("reviews_brand_panel_labeled", "reviews", "brand", "brand_reviews_panel")
register_labelled("usage_panel_labeled", "usage", "part", "usage_panel")


def register_view(name: str, source: str, cols: str, frag: str, stage: str = "signals") -> None:
    """One operator family read off the shared panel."""

    @query(name, f"SELECT {sql_cols(cols)} FROM {frag}")
    def _(t: Tables):
        df = t.labelled(source) if stage == "label" else t.signals(source)
        return portable(df, names(cols))


# ----------------------------------------------------------------- A1..A4, J1: aggregates


@query("a1_reviews_period_aggregate", f"SELECT {sql_cols(REVIEWS_BASE)} FROM reviews_aged")
def _(t: Tables):
    return portable(
        panel.reviews_panel(t.reviews_log(), text_key="TextKey"), names(REVIEWS_BASE)
    )


@query("a2_sales_period_aggregate", f"SELECT {sql_cols(SALES_BASE)} FROM sales_aged")
def _(t: Tables):
    return portable(panel.sales_panel(t.sales_log()), names(SALES_BASE))


@query("a3_usage_period_aggregate", f"SELECT {sql_cols(USAGE_BASE)} FROM usage_aged")
def _(t: Tables):
    return portable(
        panel.usage_panel(t.usage_log(), grain="week"), names(USAGE_BASE)
    )


_FIRSTS = {
    "sales": ("StockCode", "first_sale_date", "InvoiceDate"),
    "reviews": ("ProductId", "first_review_date", "review_date"),
    "usage": ("product_id", "first_event_date", "event_time"),
}


@query(
    "a4_first_event_per_product",
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, \"{i}\"::VARCHAR AS product, "
        f"strftime(min(\"{ts}\"), '%Y-%m-%d %H:%M:%S') AS first_seen FROM {s}_clean GROUP BY \"{i}\""
        for s, (i, _, ts) in _FIRSTS.items()
    ),
)
def _(t: Tables):
    clean = {
        "sales": cleaning.clean_sales(t.sales_log()),
        "reviews": cleaning.clean_reviews(t.reviews_log(), "TextKey").withColumn(
            "review_date", S.timestamp_from_unix(F.col("Time"))
        ),
        "usage": cleaning.clean_events(t.usage_log()),
    }
    out = None
    for s, (i, _, ts) in _FIRSTS.items():
        part = clean[s].groupBy(F.col(i).cast("string").alias("product")).agg(
            F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first_seen")
        ).select(F.lit(s).alias("source"), "product", "first_seen")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j1_panel_with_first_date",
    f"SELECT {sql_cols(ID_TIME['sales'] + ' m:first_sale_date i:transaction_count')} FROM sales_aged",
)
def _(t: Tables):
    return portable(
        panel.sales_panel(t.sales_log()), ["StockCode", "month", "first_sale_date", "transaction_count"]
    )


# ----------------------------------------------------------------- P7..P12

register_view(
    "p7_null_safe_ratios", "usage",
    ID_TIME["usage"] + " d:view_to_cart_rate d:cart_to_purchase_rate d:conversion_rate d:funnel_efficiency",
    "usage_aged",
)


@query(
    "p8_unit_ratios",
    f"""SELECT 'sales' AS source, "StockCode" AS product, strftime(month, '%Y-%m-%d') AS month,
        {r6('aov')} AS value_a, {r6('customer_concentration')} AS value_b FROM sales_velocity
        UNION ALL SELECT 'usage', product_id::VARCHAR, strftime(month, '%Y-%m-%d'),
        {r6('engagement_per_session')}, NULL FROM usage_aged""",
)
def _(t: Tables):
    sales = t.sales().select(
        F.lit("sales").alias("source"), F.col("StockCode").alias("product"),
        F.date_format("month", "yyyy-MM-dd").alias("month"),
        rounded(F.col("aov")).alias("value_a"),
        rounded(F.col("customer_concentration")).alias("value_b"),
    )
    usage = t.usage().select(
        F.lit("usage").alias("source"), F.col("product_id").cast("string").alias("product"),
        F.date_format("month", "yyyy-MM-dd").alias("month"),
        rounded(F.col("engagement_per_session")).alias("value_a"),
        F.lit(None).cast("double").alias("value_b"),
    )
    return sales.unionByName(usage)


_AGES = [("sales", "StockCode"), ("reviews", "ProductId"), ("usage", "product_id")]


@query(
    "p9_product_age_months",
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, \"{i}\"::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month, "
        f"{r6('product_age_months')} AS product_age_months FROM {s}_aged"
        for s, i in _AGES
    ),
)
def _(t: Tables):
    return _union_ages(t, "product_age_months")


@query(
    "p10_lifecycle_stage",
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, \"{i}\"::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month, "
        f"lifecycle_stage FROM {s}_velocity"
        for s, i in _AGES
    ),
)
def _(t: Tables):
    return _union_ages(t, "lifecycle_stage")


def _union_ages(t: Tables, col: str):
    panels = {
        "sales": panel.sales_panel(t.sales_log()),
        "reviews": panel.reviews_panel(t.reviews_log(), text_key="TextKey"),
        "usage": panel.usage_panel(t.usage_log(), grain="week"),
    }
    out = None
    for s, i in _AGES:
        part = portable(
            panels[s].select(
                F.lit(s).alias("source"), F.col(i).cast("string").alias("product"), "month", col
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p11_scoring_lifecycle_stage",
    f"""SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month, lifecycle_stage,
        CASE WHEN product_age_months < 3 THEN 'introduction' WHEN product_age_months < 12 THEN 'growth'
             WHEN product_age_months < 24 THEN 'maturity' ELSE 'decline' END AS scoring_stage
        FROM usage_velocity""",
)
def _(t: Tables):
    df = panel.usage_panel(t.usage_log(), grain="week")
    df = df.withColumn("scoring_stage", S.lifecycle_stage(F.col("product_age_months")))
    return portable(df, ["product_id", "month", "lifecycle_stage", "scoring_stage"])


register_view(
    "p12_sentiment_polarization", "reviews", ID_TIME["reviews"] + " i:sentiment_polarization",
    "reviews_velocity",
)

# ----------------------------------------------------------------- W1..W4


def _register_three(name: str, cols: dict[str, str], suffix: str = "signals") -> None:
    for source, wanted in cols.items():
        register_view(f"{name}_{source}", source, f"{ID_TIME[source]} {wanted}", f"{source}_{suffix}")


_register_three("w1_first_difference", {
    "reviews": "d:sentiment_velocity",
    "usage": "d:conversion_rate_change d:funnel_efficiency_change",
})
_register_three("w2_second_difference", {
    "reviews": "d:sentiment_acceleration", "sales": "d:revenue_acceleration",
    "usage": "d:engagement_acceleration",
})
_register_three("w3_percent_change", {
    "reviews": "d:review_momentum d:reviewer_diversity_change",
    "sales": "d:revenue_velocity d:customer_churn_rate d:order_frequency_change d:aov_change",
    "usage": (
        "d:engagement_velocity d:user_retention_rate d:session_frequency_change "
        "d:purchase_momentum d:engagement_quality_change"
    ),
})
_register_three("w4_rolling_std", {
    "reviews": "d:sentiment_volatility", "sales": "d:revenue_volatility",
    "usage": "d:engagement_volatility",
})

# ----------------------------------------------------------------- L1..L3

register_view("l1_emotional_label", "reviews", ID_TIME["reviews"] + " s:fatigue_label", "reviews_panel", "label")
register_view("l2_financial_label", "sales", ID_TIME["sales"] + " s:fatigue_label", "sales_panel", "label")
register_view("l3_behavioural_label", "usage", ID_TIME["usage"] + " s:fatigue_label", "usage_panel", "label")

# ----------------------------------------------------------------- W14, A25, A26, F14


def _z_sql(source: str, p: str) -> tuple[str, str]:
    spec = specs.SOURCES[source]
    params = ", ".join(
        f"avg(coalesce({c}, 0)) AS mean_{z}, stddev_pop(coalesce({c}, 0)) AS std_{z}"
        for z, c in spec.z_columns
    )
    fragment(f"{p}_z_params", f"SELECT {params} FROM {p}_panel")
    zs = ", ".join(
        f"(coalesce({c}, 0) - mean_{z}) / nullif(std_{z}, 0) AS {z}" for z, c in spec.z_columns
    )
    fragment(f"{p}_z", f"SELECT p.*, {zs} FROM {p}_panel p, {p}_z_params")
    hit = " OR ".join(f"{z} < -3" for z, _ in spec.z_columns)
    fragment(f"{p}_z_outliers", f"SELECT * FROM {p}_z WHERE {hit}")
    return params, zs


for _s in ("sales", "reviews", "usage", "brand_sales", "brand_reviews"):
    _z_sql(_s.removeprefix("brand_"), _s)


def _register_z(source: str) -> None:
    spec = specs.SOURCES[source]
    cols = ID_TIME[source] + " " + " ".join(f"d:{z}" for z, _ in spec.z_columns)

    @query(f"w14_z_scores_{source}", f"SELECT {sql_cols(cols)} FROM {source}_z")
    def _(t: Tables):
        return portable(signals.z_scores(t.signals(source), spec), names(cols))


for _s in ("sales", "reviews", "usage"):
    _register_z(_s)


@query(
    "f14_z_outlier_rows",
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, \"{specs.SOURCES[s.removeprefix('brand_')].id_col}\"::VARCHAR AS product, "
        f"strftime(month, '%Y-%m-%d') AS month FROM {s}_z_outliers"
        for s in ("brand_sales", "brand_reviews", "usage")
    ).replace("'brand_", "'"),
)
def _(t: Tables):
    out = None
    for s in ("sales", "reviews", "usage"):
        spec = specs.SOURCES[s]
        hits = signals.z_outliers(signals.z_scores(t.signals(s, "brand"), spec), spec)
        part = portable(
            hits.select(
                F.lit(s).alias("source"), F.col(spec.id_col).cast("string").alias("product"), "month"
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a25_z_parameters",
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{z}' AS name, {r6(f'mean_{z}')} AS mean, {r6(f'std_{z}')} AS std "
        f"FROM {s}_z_params"
        for s in ("sales", "reviews", "usage")
        for z, _ in specs.SOURCES[s].z_columns
    ),
)
def _(t: Tables):
    out = None
    for s in ("sales", "reviews", "usage"):
        spec = specs.SOURCES[s]
        params = signals.z_parameters(t.signals(s), spec)
        items = F.array(*[
            F.struct(
                F.lit(z).alias("name"), rounded(F.col(f"mean_{z}")).alias("mean"),
                rounded(F.col(f"std_{z}")).alias("std"),
            )
            for z, _ in spec.z_columns
        ])
        part = params.select(F.lit(s).alias("source"), F.inline(items))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a26_outlier_summary",
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, count(*) AS n_rows, count(DISTINCT \"{specs.SOURCES[s].id_col}\") AS n_products "
        f"FROM {s}_z_outliers"
        for s in ("sales", "reviews", "usage")
    ),
)
def _(t: Tables):
    out = None
    for s in ("sales", "reviews", "usage"):
        spec = specs.SOURCES[s]
        hits = signals.z_outliers(signals.z_scores(t.signals(s), spec), spec)
        part = hits.agg(
            F.count("*").alias("n_rows"), F.countDistinct(spec.id_col).alias("n_products")
        ).select(F.lit(s).alias("source"), "n_rows", "n_products")
        out = part if out is None else out.unionByName(part)
    return out


# ----------------------------------------------------------------- C11, P19, F13


@query("c11_usage_severity_relabel", f"""
SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month, fatigue_label AS before,
  CASE WHEN fatigue_label = 'moderate_fatigue' AND
    (coalesce(purchase_count, 0) <= 0)::INT + (coalesce(conversion_rate, 0) <= 0)::INT
    + (coalesce(funnel_efficiency, 0) <= 0)::INT + (coalesce(cart_count, 0) <= 1)::INT
    + (coalesce(engagement_total, 0) <= 45)::INT + (coalesce(view_to_cart_rate, 0) <= 0.5)::INT
    + (coalesce(engagement_per_session, 99) <= 1.14)::INT >= 4
  THEN 'high_fatigue' ELSE fatigue_label END AS after
FROM usage_panel""")
def _(t: Tables):
    df = t.labelled("usage").withColumn("before", F.col("fatigue_label"))
    df = labels.usage_severity(df).withColumn("after", F.col("fatigue_label"))
    return portable(df, ["product_id", "month", "before", "after"])


@query("p19_binary_label", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month,
  CASE WHEN fatigue_label IN ('high_fatigue', 'moderate_fatigue') THEN 'fatigued'
       ELSE fatigue_label END AS binary_label
FROM sales_panel""")
def _(t: Tables):
    df = t.labelled("sales").withColumn("binary_label", labels.binary_label(F.col("fatigue_label")))
    return portable(df, ["StockCode", "month", "binary_label"])


@query("f13_labelled_rows_only", """
SELECT "StockCode", count(*) AS n_rows FROM brand_sales_forward_quantile GROUP BY ALL""")
def _(t: Tables):
    scored = labels.score_to_class(
        labels.forward_score(t.sales("brand"), specs.SALES, 2), "quantile", True
    )
    kept = scored.dropna(subset=["fatigue_label"])
    return kept.groupBy("StockCode").agg(F.count("*").alias("n_rows"))


fragment("brand_sales_forward_quantile", """
SELECT "StockCode", month FROM (
  SELECT *, lead(1) OVER (PARTITION BY "StockCode" ORDER BY month) AS later FROM brand_sales_signals
) WHERE later IS NOT NULL""")
