"""History features, forward labels, splits, stability and preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators import history, labels, prep, splits, stability, summaries
from ebbtide.plans.base import Tables, fragment, query, r6, sql_bucket
from ebbtide.plans.panels import FULL, ID_TIME
from ebbtide.plans.shape import names, portable, sql_cols
from ebbtide.session import dealt, stored

# ----------------------------------------------------------------- W5..W8


def _trailing_sql(source: str, idc: str) -> str:
    spec = specs.SOURCES[source]
    frame = f'(PARTITION BY "{idc}" ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)'
    return ", ".join(
        f"CASE WHEN count({c}) OVER {frame} >= 2 THEN avg({c}) OVER {frame} END AS roll3_mean_{c}"
        for c in spec.trailing_mean_columns
    )


fragment("reviews_trailing", f"SELECT *, {_trailing_sql('reviews', 'ProductId')} FROM reviews_signals")
fragment("reviews_history", "SELECT *, " + ", ".join(
    f"{c} - roll3_mean_{c} AS {c}_vs_trailing_mean" for c in specs.REVIEWS.trailing_mean_columns
) + """, sentiment_mean - lag(sentiment_mean) OVER w AS safe_sentiment_change,
  (review_count - lag(review_count) OVER w)::DOUBLE / nullif(lag(review_count) OVER w, 0) * 100
    AS safe_review_count_change_pct
FROM reviews_trailing WINDOW w AS (PARTITION BY "ProductId" ORDER BY month)""")
fragment("usage_history", f"""SELECT *, {_trailing_sql('usage', 'product_id')},
  (engagement_per_session - lag(engagement_per_session) OVER w)
    / nullif(lag(engagement_per_session) OVER w, 0) * 100 AS safe_engagement_quality_change
FROM usage_signals WINDOW w AS (PARTITION BY product_id ORDER BY month)""")

_HISTORY = {
    "w5_trailing_mean_reviews": ("reviews", " ".join(f"d:roll3_mean_{c}" for c in specs.REVIEWS.trailing_mean_columns)),
    "w5_trailing_mean_usage": ("usage", " ".join(f"d:roll3_mean_{c}" for c in specs.USAGE.trailing_mean_columns)),
    "w6_deviation_from_trailing_mean": ("reviews", " ".join(f"d:{c}_vs_trailing_mean" for c in specs.REVIEWS.trailing_mean_columns)),
    "w7_safe_changes_reviews": ("reviews", "d:safe_sentiment_change d:safe_review_count_change_pct"),
    "w7_safe_changes_usage": ("usage", "d:safe_engagement_quality_change"),
}


def _register_history(name: str, source: str, cols: str) -> None:
    wanted = f"{ID_TIME[source]} {cols}"

    @query(name, f"SELECT {sql_cols(wanted)} FROM {source}_history")
    def _(t: Tables):
        return portable(history.history_features(t.signals(source), specs.SOURCES[source]), names(wanted))


for _name, (_source, _cols) in _HISTORY.items():
    _register_history(_name, _source, _cols)


@query("w8_forward_mean", f"""
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, {r6('avg(revenue_total) OVER w')} AS mean_ahead,
       lead(1) OVER (PARTITION BY "StockCode" ORDER BY month) IS NOT NULL AS scored
FROM sales_aged WINDOW w AS (PARTITION BY "StockCode" ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def _(t: Tables):
    w = Window.partitionBy("StockCode").orderBy("month")
    return portable(t.sales().select(
        "StockCode", "month", F.avg("revenue_total").over(w.rowsBetween(1, 4)).alias("mean_ahead"),
        F.lead(F.lit(1)).over(w).isNotNull().alias("scored"),
    ))


_STAGE_SQL = ("CASE WHEN product_age_months < 0 THEN NULL WHEN product_age_months < 3 THEN 'introduction' "
              "WHEN product_age_months < 12 THEN 'growth' WHEN product_age_months < 24 THEN 'maturity' "
              "WHEN product_age_months >= 24 THEN 'decline' END")


def _register_age_dev(source: str) -> None:
    spec = specs.SOURCES[source]
    devs = ", ".join(
        f"CASE WHEN age_stage IS NOT NULL THEN ({c} - avg({c}) OVER (PARTITION BY age_stage)) / "
        f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY age_stage) = 0 THEN 1 "
        f"ELSE stddev_samp({c}) OVER (PARTITION BY age_stage) END END AS {c}_age_dev"
        for c in spec.age_dev_columns
    )
    fragment(f"{source}_age_dev", f"SELECT *, {devs} FROM (SELECT *, {_STAGE_SQL} AS age_stage FROM {source}_signals)")
    cols = f"{ID_TIME[source]} " + " ".join(f"d:{c}_age_dev" for c in spec.age_dev_columns)

    @query(f"w9_age_deviation_{source}", f"SELECT {sql_cols(cols)} FROM {source}_age_dev")
    def _(t: Tables):
        return portable(stability.age_deviations(t.signals(source), spec.age_dev_columns), names(cols))


for _s in ("reviews", "sales", "usage"):
    _register_age_dev(_s)


@query("j8_stage_statistics_joined_back", f"""
SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month, {r6('purchase_count_age_dev')} AS purchase_count_age_dev
FROM (SELECT *, CASE WHEN stddev_samp(purchase_count) OVER g = 0 THEN 0.0 ELSE 1.0 END AS flag,
  (purchase_count - avg(purchase_count) OVER g) / CASE WHEN stddev_samp(purchase_count) OVER g = 0 THEN 1
   ELSE stddev_samp(purchase_count) OVER g END AS purchase_count_age_dev
  FROM (SELECT *, coalesce({_STAGE_SQL}, 'nan') || '_' || lifecycle_stage AS age_key FROM usage_signals)
  WINDOW g AS (PARTITION BY age_key))""")
def _(t: Tables):
    df = stability.age_deviations(t.usage(), ["purchase_count"], category_col="lifecycle_stage")
    return portable(df, ["product_id", "month", "purchase_count_age_dev"])


@query("w10_row_position_per_product", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, position, n_rows,
  position > n_rows - CASE WHEN n_rows < 2 THEN 0 ELSE greatest(1, round_even(n_rows * 0.2::DOUBLE, 0)) END AS held_out
FROM (SELECT "StockCode", month, row_number() OVER (PARTITION BY "StockCode" ORDER BY month) AS position,
             count(*) OVER (PARTITION BY "StockCode") AS n_rows FROM sales_aged)""")
def _(t: Tables):
    df = stored(t.sales().select("StockCode", "month"), "positions")
    n = df.count()
    train, test = splits.per_product_split(dealt(df, n, "StockCode"), "StockCode", "month", 0.2)
    marked = dealt(train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True))), n, "StockCode")
    w = Window.partitionBy("StockCode")
    return portable(marked.select(
        "StockCode", "month", F.row_number().over(w.orderBy("month")).alias("position"),
        F.count("*").over(w).alias("n_rows"), "held_out",
    ))


@query("w11_period_rank", """
SELECT strftime(month, '%Y-%m-%d') AS month, row_number() OVER (ORDER BY month) - 1 AS rank
FROM (SELECT DISTINCT month FROM sales_agg)""")
def _(t: Tables):
    return portable(splits.period_ranks(t.sales(), "month"))


# ----------------------------------------------------------------- L4..L8

_PARTS_SQL = {
    "reviews": ("ProductId", [("sentiment_mean", .5, None, 1), ("sentiment_std", .25, 0, -1), ("review_count", .25, 1, 1)]),
    "sales": ("StockCode", [("revenue_total", .5, 0, 1), ("transaction_count", .3, 1, 1), ("avg_price", .2, 0, 1)]),
    "usage": ("product_id", [("engagement_total", .4, 0, 1), ("conversion_rate", .35, 0, 1), ("purchase_count", .25, 0, 1)]),
}


def _forward_sql(source: str, frag: str, horizon: int) -> str:
    idc, parts = _PARTS_SQL[source]
    terms = []
    for c, weight, missing, sign in parts:
        now = f"{c}::DOUBLE" if missing is None else f"coalesce({c}::DOUBLE, {missing}::DOUBLE)"
        terms.append(f"greatest(({now} - avg({c}) OVER f) * {sign}, 0) / greatest(abs({now}), 0.01::DOUBLE) * {weight}::DOUBLE")
    return f"""SELECT *, CASE WHEN lead(1) OVER o IS NOT NULL AND {parts[0][0]} IS NOT NULL
  THEN least(greatest({' + '.join(terms)}, 0), 1) END AS fatigue_score FROM {frag}
WINDOW o AS (PARTITION BY "{idc}" ORDER BY month),
       f AS (PARTITION BY "{idc}" ORDER BY month ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)"""


for _s in ("reviews", "sales", "usage"):
    fragment(f"{_s}_forward", _forward_sql(_s, f"{_s}_signals", 2))
fragment("brand_sales_forward", _forward_sql("sales", "brand_sales_signals", 2))
fragment("brand_reviews_forward", _forward_sql("reviews", "brand_reviews_signals", 2))


def _register_forward(name: str, source: str) -> None:
    cols = f"{ID_TIME[source]} d:fatigue_score"

    @query(name, f"SELECT {sql_cols(cols)} FROM {source}_forward")
    def _(t: Tables):
        return portable(labels.forward_score(t.signals(source), specs.SOURCES[source], 2), names(cols))


_register_forward("l4_forward_score_reviews", "reviews")
_register_forward("l5_forward_score_sales", "sales")
_register_forward("l6_forward_score_usage", "usage")


def _class_sql(frag: str, idc: str) -> str:
    return f"""SELECT "{idc}"::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month,
  CASE WHEN s <= lo THEN 'healthy' WHEN s <= hi THEN 'moderate_fatigue' ELSE 'high_fatigue' END AS by_tercile,
  CASE WHEN s <= mid THEN 'healthy' ELSE 'fatigued' END AS by_median,
  CASE WHEN s <= 0.33 THEN 'healthy' WHEN s <= 0.66 THEN 'moderate_fatigue' ELSE 'high_fatigue' END AS by_fixed
FROM (SELECT *, fatigue_score AS s FROM {frag} WHERE fatigue_score IS NOT NULL),
  (SELECT CASE WHEN lo >= hi THEN 0.2 ELSE lo END AS lo, CASE WHEN lo >= hi THEN 0.5 ELSE hi END AS hi, mid FROM (
   SELECT quantile_cont(fatigue_score, 0.33) AS lo, quantile_cont(fatigue_score, 0.66) AS hi,
          quantile_cont(fatigue_score, 0.5) AS mid FROM {frag}))"""


@query("l7_score_to_class", _class_sql("brand_sales_forward", "StockCode"))
def _(t: Tables):
    scored = labels.forward_score(t.sales("brand"), specs.SALES, 2).where(F.col("fatigue_score").isNotNull())
    out = labels.score_to_class(scored, "quantile").withColumn("by_tercile", F.col("fatigue_label"))
    out = labels.score_to_class(out, "quantile", binary=True, fit_on=scored).withColumn("by_median", F.col("fatigue_label"))
    out = labels.score_to_class(out, "fixed").withColumn("by_fixed", F.col("fatigue_label"))
    return portable(out.select(F.col("StockCode").alias("product"), "month", "by_tercile", "by_median", "by_fixed"))


def _register_l8(source: str, frag: str) -> None:
    spec = specs.SOURCES[source]
    cols = f"{ID_TIME[source]} s:fatigue_label d:fatigue_score"

    @query(f"l8_forward_labels_{source}", f"""
SELECT {sql_cols(cols)} FROM (SELECT * EXCLUDE (lo, hi),
  CASE WHEN fatigue_score <= lo THEN 'healthy' WHEN fatigue_score <= hi THEN 'moderate_fatigue'
       ELSE 'high_fatigue' END AS fatigue_label
  FROM {frag}, (SELECT quantile_cont(fatigue_score, 0.33) AS lo, quantile_cont(fatigue_score, 0.66) AS hi FROM {frag})
  WHERE fatigue_score IS NOT NULL)""")
    def _(t: Tables):
        panel = t.labelled(source, "brand").drop("fatigue_label")
        return portable(labels.forward_labels(panel, spec, 2), names(cols))


_register_l8("sales", "brand_sales_forward")
_register_l8("reviews", "brand_reviews_forward")
_register_l8("usage", "usage_forward")

# ----------------------------------------------------------------- splits and folds


def _roles(train, test):
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


def _split_counts(train, test):
    return _roles(train, test).groupBy("role", "fatigue_label").agg(F.count("*").alias("n_rows"))


@query("i2_last_periods_split", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, 'train' AS role FROM brand_sales_train
UNION ALL SELECT "StockCode", strftime(month, '%Y-%m-%d'), 'test' FROM brand_sales_test""")
def _(t: Tables):
    df = t.sales("brand").select("StockCode", "month")
    return portable(_roles(*splits.last_periods_split(df, "month", 3)))


@query("j4_period_membership", """
SELECT fatigue_label, count(*) AS n_rows FROM brand_sales_test GROUP BY ALL""")
def _(t: Tables):
    _, test = splits.last_periods_split(t.labelled("sales", "brand"), "month", 3)
    return test.groupBy("fatigue_label").agg(F.count("*").alias("n_rows"))


fragment("sales_period_rank", """
SELECT month, count(*) AS n_rows, row_number() OVER (ORDER BY month) - 1 AS rank, count(*) OVER () AS n_periods
FROM brand_sales_panel GROUP BY month""")


@query("i3_walk_forward_folds", """
SELECT f.fold::BIGINT AS fold, CASE WHEN rank < f.fold THEN 'train' ELSE 'validation' END AS role,
       sum(n_rows)::BIGINT AS n_rows, strftime(min(month), '%Y-%m-%d') AS first_period, strftime(max(month), '%Y-%m-%d') AS last_period
FROM sales_period_rank JOIN (SELECT unnest(generate_series(6, 500)) AS fold) f
  ON f.fold <= n_periods - 1 AND rank <= f.fold GROUP BY ALL""")
def _(t: Tables):
    panel = t.sales("brand")
    per_period = panel.groupBy("month").agg(F.count("*").alias("n_rows"))
    ranked = splits.period_ranks(panel, "month").join(per_period, "month")
    n = panel.agg(F.countDistinct("month")).scalar().cast("int")
    out = splits.fold_roles(ranked, n, 6, 1).groupBy("fold", "role").agg(
        F.sum("n_rows").alias("n_rows"), F.min("month").alias("first_period"), F.max("month").alias("last_period")
    )
    return portable(out)


@query("j5_fold_expansion", """
SELECT f.fold::BIGINT AS fold, "StockCode", count(*) FILTER (rank < f.fold) AS n_train,
       count(*) FILTER (rank >= f.fold) AS n_validation
FROM (SELECT p."StockCode", r.rank, r.n_periods FROM brand_sales_panel p JOIN sales_period_rank r USING (month))
JOIN (SELECT unnest(generate_series(6, 500)) AS fold) f
  ON f.fold <= n_periods - 2 AND rank < f.fold + 2 GROUP BY ALL""")
def _(t: Tables):
    df = t.sales("brand").select("StockCode", "month")
    ranked = df.join(F.broadcast(splits.period_ranks(df, "month")), "month")  # calendar-bounded
    totals = ranked.groupBy("StockCode", "rank").agg(F.count("*").alias("n"))
    n = df.agg(F.countDistinct("month")).scalar().cast("int")
    out = splits.fold_roles(totals, n, 6, 2).groupBy("fold", "StockCode").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "train", F.col("n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(F.col("role") == "validation", F.col("n"))), F.lit(0)).alias("n_validation"),
    )
    return portable(out)


@query("i4_per_product_split", """
SELECT CASE WHEN position > n_rows - held THEN 'test' ELSE 'train' END AS role, fatigue_label, count(*) AS n_rows
FROM (SELECT fatigue_label, row_number() OVER (PARTITION BY "StockCode" ORDER BY month) AS position,
        count(*) OVER (PARTITION BY "StockCode") AS n_rows,
        CASE WHEN count(*) OVER (PARTITION BY "StockCode") < 2 THEN 0
             ELSE greatest(1, round_even(count(*) OVER (PARTITION BY "StockCode") * 0.2::DOUBLE, 0)) END AS held
      FROM sales_panel) GROUP BY ALL""")
def _(t: Tables):
    return _split_counts(*splits.per_product_split(t.labelled("sales"), "StockCode", "month", 0.2))


@query("i5_split_fallback_check", """
SELECT count(*) AS n_classes, min(n)::BIGINT AS smallest, count(*) < 2 OR min(n) < 10 AS fallback
FROM (SELECT fatigue_label, count(*) AS n FROM brand_sales_train GROUP BY ALL)""")
def _(t: Tables):
    train, _test = splits.last_periods_split(t.labelled("sales", "brand"), "month", 3)
    counts = train.groupBy("fatigue_label").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"), F.min("n").alias("smallest"),
        ((F.count("*") < 2) | (F.min("n") < 10)).alias("fallback"),
    )


_KEY_SQL = "\"StockCode\" || '|' || strftime(month, '%Y-%m-%d')"


def _class_rank_sql(salt: str) -> str:
    hashed = sql_bucket(_KEY_SQL + f" || '{salt}'", 4294967296)
    return f'row_number() OVER (PARTITION BY fatigue_label ORDER BY {hashed}, "StockCode", month)'


@query("i6_stratified_split", f"""
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month,
  CASE WHEN {_class_rank_sql("split")} <= floor(count(*) OVER (PARTITION BY fatigue_label) * 0.2::DOUBLE + 0.5)
    THEN 'test' ELSE 'train' END AS role
FROM brand_sales_panel""")
def _(t: Tables):
    df = t.labelled("sales", "brand").select("StockCode", "month", "fatigue_label")
    parts = splits.stratified_split(df, "fatigue_label", ["StockCode", "month"], 0.2)
    return portable(_roles(*parts), ["StockCode", "month", "role"])


@query("i7_fold_numbers", f"""
SELECT fold, fatigue_label, count(*) AS n_rows, count(DISTINCT "StockCode") AS n_products
FROM (SELECT *, ({_class_rank_sql("fold")} - 1) % 5 AS fold FROM brand_sales_panel) GROUP BY ALL""")
def _(t: Tables):
    df = t.labelled("sales", "brand").select("StockCode", "month", "fatigue_label")
    df = splits.stratified_folds(df, "fatigue_label", ["StockCode", "month"], 5)
    return portable(df.groupBy(F.col("_fold").cast("long").alias("fold"), "fatigue_label").agg(
        F.count("*").alias("n_rows"), F.count_distinct("StockCode").alias("n_products")
    ))


@query("f15_labels_seen_in_training", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, fatigue_label FROM brand_sales_test
WHERE fatigue_label IN (SELECT fatigue_label FROM brand_sales_train)""")
def _(t: Tables):
    train, test = splits.last_periods_split(t.labelled("sales", "brand"), "month", 3)
    kept = splits.seen_labels(test, train, "fatigue_label")
    return portable(kept.select("StockCode", "month", "fatigue_label"))


# ----------------------------------------------------------------- stability and preparation

_FEATURES = {
    s: [w.split(":")[1] for w in FULL[s].split() if w[0] in "di" and not w.endswith(":product_id")]
    for s in ("reviews", "sales", "usage")
}
_RATIOS = {s: stability.ratio_columns(c) for s, c in _FEATURES.items()}


@query("c1_capped_ratios", f"""
SELECT product_id::BIGINT AS product_id, strftime(month, '%Y-%m-%d') AS month, """ + ", ".join(
    r6(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END") + f" AS {c}" for c in _RATIOS["usage"]
) + " FROM usage_signals, (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _RATIOS["usage"]
) + " FROM usage_signals)")
def _(t: Tables):
    panel = t.usage()
    capped = stability.cap(panel, stability.cap_bounds(panel, _RATIOS["usage"]))
    return portable(capped, ["product_id", "month", *_RATIOS["usage"]])


def _dead_sql(source: str, frag: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{source}' AS source, '{c}' AS \"column\" FROM (SELECT avg(({c} IS NULL)::INT) AS nulls FROM {frag}), "
        f"(SELECT max(n)::DOUBLE / sum(n) AS top FROM (SELECT count(*) AS n FROM {frag} WHERE {c} IS NOT NULL GROUP BY {c})) "
        "WHERE nulls > 0.05 OR top > 0.6" for c in _FEATURES[source]
    )


@query("c2_dead_columns", _dead_sql("sales", "sales_signals"))
def _(t: Tables):
    dead = stability.dead_columns(t.sales(), _FEATURES["sales"], max_null=0.05, max_constant=0.6)
    return dead.select(F.lit("sales").alias("source"), "column")


def _twin_sql(cols, frag: str) -> str:
    tests = "\nUNION ALL\n".join(
        f"SELECT '{b}' AS \"column\", corr({a}, {b}) AS r FROM {frag}" for i, a in enumerate(cols) for b in cols[i + 1:]
    )
    return f'SELECT DISTINCT "column" FROM ({tests}) WHERE abs(r) > 0.98'


@query("c3_correlated_columns", _twin_sql(_FEATURES["sales"], "brand_sales_signals"))
def _(t: Tables):
    return stability.correlated_columns(t.sales("brand"), _FEATURES["sales"])


@query("c4_stability_fixes")
def _(t: Tables):
    stable, report = stability.stabilise(t.usage(), specs.USAGE)
    added = [c for c in stable.columns if c.endswith("_age_dev")]
    row = stable.agg(*[F.count(c).alias(c) for c in added])
    values = summaries.unpivot_row(row, {c: {"n_values": c} for c in added})
    return report.withColumn("n_values", F.lit(None).cast("bigint")).unionByName(
        values.select(F.lit("added").alias("step"), "column", "n_values")
    )


@query("c5_mostly_null_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {r6(f'avg(({c} IS NULL)::INT)')} AS null_fraction, "
    f"avg(({c} IS NULL)::INT) > 0.99 AS dropped FROM brand_sales_train" for c in _FEATURES["sales"]
))
def _(t: Tables):
    train, _test = splits.last_periods_split(t.sales("brand"), "month", 3)
    table = summaries.null_fractions(train, _FEATURES["sales"])
    return portable(table.withColumn("dropped", F.col("null_fraction") > 0.99))


_FILL = ("revenue_velocity", "customer_churn_rate", "aov_change")


@query("c6_median_imputation", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, """ + ", ".join(
    r6(f"coalesce({c}, m_{c}, 0)") + f" AS {c}" for c in _FILL
) + " FROM brand_sales_panel, (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}" for c in _FILL
) + " FROM brand_sales_train)")
def _(t: Tables):
    panel = t.sales("brand")
    train, _test = splits.last_periods_split(panel, "month", 3)
    found = {r["name"]: r["median"] for r in prep.medians(train, _FILL).collect()}
    return portable(prep.impute(panel, found), ["StockCode", "month", *_FILL])


@query("j7_median_lookup", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, """ + r6("coalesce(revenue_velocity, med)") + """ AS revenue_velocity,
""" + r6("med") + """ AS absent_feature
FROM brand_sales_test, (SELECT quantile_cont(revenue_velocity, 0.5) AS med FROM brand_sales_train)""")
def _(t: Tables):
    train, test = splits.last_periods_split(t.sales("brand"), "month", 3)
    found = prep.medians(train, ["revenue_velocity"])
    median = found.select("median").scalar()
    out = test.withColumn("revenue_velocity", F.coalesce("revenue_velocity", median)).withColumn("absent_feature", median)
    return portable(out, ["StockCode", "month", "revenue_velocity", "absent_feature"])


@query("c7_one_hot_stage", """
SELECT "ProductId", strftime(p.month, '%Y-%m-%d') AS month, 'lifecycle_stage_' || s.stage AS feature,
       (p.lifecycle_stage = s.stage)::INT::DOUBLE AS flag
FROM brand_reviews_test p, (SELECT DISTINCT lifecycle_stage AS stage FROM brand_reviews_train) s""")
def _(t: Tables):
    train, test = splits.last_periods_split(t.reviews("brand"), "month", 3)
    stages = prep.categories(train, "lifecycle_stage")
    hot = prep.one_hot(test.select("ProductId", "month", "lifecycle_stage"), "lifecycle_stage", stages)
    flags = [c for c in hot.columns if c.startswith("lifecycle_stage_")]
    return portable(hot.unpivot(["ProductId", "month"], flags, "feature", "flag"))


for _side, _op in (("train", "NOT IN"), ("test", "IN")):
    fragment(f"brand_reviews_{_side}", f"""
SELECT * FROM brand_reviews_panel WHERE month {_op} (
  SELECT month FROM (SELECT DISTINCT month FROM brand_reviews_panel) ORDER BY month DESC LIMIT 3)""")


_SCALED = ("revenue_total", "transaction_count", "avg_price")


@query("c8_standardised_features", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, """ + ", ".join(
    r6(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END") + f" AS {c}" for c in _SCALED
) + " FROM brand_sales_panel, (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED
) + " FROM brand_sales_train)")
def _(t: Tables):
    panel = t.sales("brand")
    train, _test = splits.last_periods_split(panel, "month", 3)
    scaled = prep.scale(panel, prep.scale_parameters(train, _SCALED))
    return portable(scaled, ["StockCode", "month", *_SCALED])


@query("c9_label_codes", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month, fatigue_label,
  (SELECT count(DISTINCT fatigue_label) FROM brand_sales_train t WHERE t.fatigue_label < p.fatigue_label)::DOUBLE AS label
FROM brand_sales_panel p""")
def _(t: Tables):
    panel = t.labelled("sales", "brand")
    train, _test = splits.last_periods_split(panel, "month", 3)
    coded = prep.encode_label(panel, "fatigue_label", prep.label_codes(train, "fatigue_label"))
    return portable(coded, ["StockCode", "month", "fatigue_label", "label"])


@query("c10_prepared_features")
def _(t: Tables):
    prepared = prep.prepare(t.labelled("sales", "brand"), specs.SALES, test_periods=3)
    return portable(prepared.artifacts())

