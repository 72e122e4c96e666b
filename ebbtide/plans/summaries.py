"""Summary tables, distributions, coverage, quality, top lists and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators import cleaning, prep, summaries
from ebbtide.plans.base import Tables, fragment, query, r6
from ebbtide.plans.panels import FULL
from ebbtide.plans.shape import names, portable
from ebbtide.session import stored

SOURCE_NAMES = ("reviews", "sales", "usage")


def union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_sql(template: str) -> str:
    """The template for each source, with {s}, {id}, {title}, {dimension}, {signal}, {signal_title}."""
    out = []
    for s in SOURCE_NAMES:
        spec = specs.SOURCES[s]
        out.append(template.format(
            s=s, id=f'"{spec.id_col}"', title=spec.title, dimension=spec.dimension,
            signal=spec.primary_signal, signal_title=spec.primary_signal_title,
        ))
    return "\nUNION ALL\n".join(out)


def tagged(t: Tables, fn):
    """``fn(panel, spec)`` of each labelled panel with its source name."""
    return union(
        fn(t.labelled(s), specs.SOURCES[s]).select(F.lit(s).alias("source"), "*")
        for s in SOURCE_NAMES
    )


# ----------------------------------------------------------------- A5..A7, A12..A15


@query("a5_label_distribution", union_sql(
    "SELECT '{s}' AS source, fatigue_label, count(*) AS n_rows, "
    + r6("count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {s}_panel)")
    + " AS share FROM {s}_panel GROUP BY fatigue_label"
))
def _(t: Tables):
    return portable(tagged(t, lambda p, _: summaries.label_distribution(p)))


@query("a5b_fatigue_rate", union_sql(
    "SELECT '{s}' AS source, " + r6("avg((fatigue_label <> 'healthy')::INT) * 100")
    + " AS fatigue_rate FROM {s}_panel"
))
def _(t: Tables):
    return portable(tagged(t, lambda p, _: summaries.fatigue_rate(p)))


_STATS = {
    "reviews": (
        ("sentiment_mean", "mean"), ("sentiment_mean", "std"), ("sentiment_velocity", "mean"),
        ("sentiment_velocity", "std"), ("review_count", "mean"), ("review_count", "sum"),
    ),
    "usage": (
        ("engagement_total", "mean"), ("engagement_total", "std"), ("engagement_total", "median"),
        ("engagement_velocity", "mean"), ("engagement_velocity", "std"),
        ("conversion_rate", "mean"), ("conversion_rate", "std"),
        ("user_retention_rate", "mean"), ("user_retention_rate", "std"),
    ),
}
_SQL_STAT = {"mean": "avg({c})", "std": "stddev_samp({c})", "sum": "sum({c})", "median": "quantile_cont({c}, 0.5)"}


def _register_statistics(source: str) -> None:
    id_col = specs.SOURCES[source].id_col
    select = ", ".join(
        f"{r6(_SQL_STAT[k].format(c=c), 3)} AS {c}_{k}" for c, k in _STATS[source]
    )

    @query(
        f"a6_label_statistics_{source}",
        f'SELECT fatigue_label, {select}, count(DISTINCT "{id_col}") AS n_products '
        f"FROM {source}_panel GROUP BY ALL",
    )
    def _(t: Tables):
        out = summaries.label_statistics(t.labelled(source), id_col, _STATS[source], digits=9)
        return portable(out, digits=3)


_register_statistics("reviews")
_register_statistics("usage")


@query("a7_stage_by_label", "SELECT lifecycle_stage, " + ", ".join(
    f"{r6(f'avg((fatigue_label = {chr(39)}{c}{chr(39)})::INT) * 100')} AS {c}" for c in specs.CLASSES
) + " FROM usage_panel GROUP BY ALL")
def _(t: Tables):
    return portable(summaries.stage_by_label(t.labelled("usage")))


@query("a8_event_trend", """
SELECT strftime(event_time, '%Y-%m') AS year_month, event_type, count(*) AS n_events
FROM usage_clean GROUP BY ALL""")
def _(t: Tables):
    return summaries.event_trend(cleaning.clean_events(t.usage_log()))


_M = ("view_count", "cart_count", "purchase_count")


@query("a9_funnel_averages", "SELECT " + ", ".join(
    [f"{r6(f'avg({c})')} AS {c}" for c in _M]
    + [f"{r6(f'avg({c}) / nullif(avg(view_count), 0) * 100')} AS {c}_rate" for c in _M]
) + " FROM usage_agg JOIN usage_first USING (product_id)")
def _(t: Tables):
    return portable(summaries.funnel_averages(t.usage()))


def _register_correlations(source: str) -> None:
    cols = specs.SOURCES[source].correlation_columns
    sql = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM {source}_signals"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    )

    @query(f"a10_correlations_{source}", sql)
    def _(t: Tables):
        return portable(summaries.correlations(t.signals(source), cols))


for _s in SOURCE_NAMES:
    _register_correlations(_s)


@query("a12_class_rates", union_sql(
    "SELECT '{title}' AS dataset, " + ", ".join(
        r6(f"avg((fatigue_label = '{c}')::INT) * 100") + f" AS {n}"
        for n, c in (("high_rate", specs.HIGH), ("moderate_rate", specs.MODERATE), ("healthy_rate", specs.HEALTHY))
    ) + " FROM {s}_panel"
))
def _(t: Tables):
    return portable(union(
        summaries.class_rates(t.labelled(s)).select(F.lit(specs.SOURCES[s].title).alias("dataset"), "*")
        for s in SOURCE_NAMES
    ))


_N_COLUMNS = {s: len(FULL[s].split()) for s in SOURCE_NAMES}


@query("a13_dataset_overview", "\nUNION ALL\n".join(
    f"""SELECT '{specs.SOURCES[s].title}' AS dataset, count(*) AS n_rows, {_N_COLUMNS[s]}::BIGINT AS n_columns,
    count(DISTINCT "{specs.SOURCES[s].id_col}") AS n_products, strftime(min(month), '%Y-%m') AS first_month,
    strftime(max(month), '%Y-%m') AS last_month FROM {s}_panel""" for s in SOURCE_NAMES
))
def _(t: Tables):
    return union(summaries.overview(t.labelled(s), specs.SOURCES[s]) for s in SOURCE_NAMES)


@query("a14_temporal_coverage", union_sql(
    "SELECT '{title}' AS dataset, strftime(min(month), '%Y-%m') AS start, strftime(max(month), '%Y-%m') AS \"end\", "
    "count(DISTINCT month) AS n_periods, " + r6("count(*)::DOUBLE / count(DISTINCT month)")
    + " AS rows_per_period FROM {s}_panel"
))
def _(t: Tables):
    return portable(union(summaries.coverage(t.labelled(s), specs.SOURCES[s]) for s in SOURCE_NAMES))


@query("a15_key_metrics", union_sql(
    "SELECT '{title}' AS dataset, '{dimension}' AS dimension, '{signal_title}' AS primary_signal, "
    + r6("avg({signal})") + " AS avg_signal, "
    "count(DISTINCT CASE WHEN fatigue_label = 'high_fatigue' THEN {id} END) AS high_fatigue_products FROM {s}_panel"
))
def _(t: Tables):
    return portable(union(summaries.key_metrics(t.labelled(s), specs.SOURCES[s]) for s in SOURCE_NAMES))


@query("x22_class_rate_read_model", union_sql(
    "SELECT '{title}' AS dataset, "
    + r6("avg((fatigue_label = 'high_fatigue')::INT) * 100") + " AS high_rate, "
    + r6("avg((fatigue_label = 'moderate_fatigue')::INT) * 100") + " AS moderate_rate, "
    + r6("avg({signal})") + " AS avg_signal, "
    "count(DISTINCT CASE WHEN fatigue_label = 'high_fatigue' THEN {id} END) AS high_fatigue_products FROM {s}_panel"
))
def _(t: Tables):
    parts = []
    for s in SOURCE_NAMES:
        p, spec = t.labelled(s), specs.SOURCES[s]
        high = F.when(F.col("fatigue_label") == specs.HIGH, F.col(spec.id_col))
        parts.append(p.agg(
            summaries.share_percent(F.col("fatigue_label") == specs.HIGH).alias("high_rate"),
            summaries.share_percent(F.col("fatigue_label") == specs.MODERATE).alias("moderate_rate"),
            F.avg(spec.primary_signal).alias("avg_signal"),
            F.countDistinct(high).alias("high_fatigue_products"),
        ).select(F.lit(spec.title).alias("dataset"), "*"))
    return portable(union(parts))


# ----------------------------------------------------------------- A16..A24, A27


def _quality_sql(source: str) -> str:
    out = []
    for word in FULL[source].split():
        name = word.split(":")[1]
        out.append(
            f"SELECT '{source}' AS source, '{name}' AS \"column\", count(*) AS n_rows, "
            f'count(*) - count("{name}") AS n_null, 0::BIGINT AS n_non_finite, '
            f'count("{name}") = 0 AS all_null FROM {source}_panel'
        )
    return "\nUNION ALL\n".join(out)


@query("a16_column_quality", "\nUNION ALL\n".join(map(_quality_sql, SOURCE_NAMES)))
def _(t: Tables):
    return union(
        summaries.column_quality(t.labelled(s).select(*names(FULL[s]))).select(
            F.lit(s).alias("source"), "*"
        )
        for s in SOURCE_NAMES
    )


_HISTOGRAMS = (
    ("reviews", "sentiment_mean", 50, False), ("reviews", "review_momentum", 30, False),
    ("sales", "revenue_total", 60, True), ("sales", "customer_concentration", 50, False),
    ("usage", "engagement_total", 50, True), ("usage", "conversion_rate", 60, False),
)


def _histogram_sql(source: str, col: str, bins: int, log: bool) -> str:
    v = f"log10({col})" if log else col
    positive = f"AND {col} > 0" if log else ""
    return f"""SELECT '{source}' AS source, '{col}' AS metric,
  coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * {bins}), {bins - 1}), 0)::BIGINT AS bin, count(*) AS n_rows
FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi
      FROM (SELECT ({v})::DOUBLE AS v FROM {source}_signals WHERE {col} IS NOT NULL {positive}))
GROUP BY ALL"""


@query("a17_histograms", "\nUNION ALL\n".join(_histogram_sql(*h) for h in _HISTOGRAMS))
def _(t: Tables):
    panels = {s: t.signals(s) for s in SOURCE_NAMES}
    return union(
        summaries.histogram(panels[s], c, bins, log).select(
            F.lit(s).alias("source"), F.lit(c).alias("metric"), "bin", "n_rows"
        )
        for s, c, bins, log in _HISTOGRAMS
    )


_BOXES = (
    ("reviews", "sentiment_mean", "lifecycle_stage"), ("reviews", "sentiment_mean", "fatigue_label"),
    ("sales", "revenue_total", "lifecycle_stage"), ("usage", "engagement_total", "fatigue_label"),
    ("usage", "conversion_rate", "fatigue_label"),
)


@query("a18_five_number_summaries", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS source, '{c}' AS metric, {by} AS grp, {r6(f'min({c})')} AS minimum, "
    + ", ".join(f"{r6(f'quantile_cont({c}, {p})')} AS {n}" for n, p in (("q1", .25), ("median", .5), ("q3", .75)))
    + f", {r6(f'max({c})')} AS maximum FROM {s}_panel GROUP BY {by}" for s, c, by in _BOXES
))
def _(t: Tables):
    parts = []
    for s in SOURCE_NAMES:
        boxes = [(c, by) for name, c, by in _BOXES if name == s]
        panel = stored(t.labelled(s).select(*dict.fromkeys(x for box in boxes for x in box)), f"boxes-{s}")
        for by in dict.fromkeys(by for _, by in boxes):
            parts += [
                numbers.withColumnRenamed(by, "grp").select(F.lit(s).alias("source"), F.lit(c).alias("metric"), "*")
                for c, numbers in summaries.five_numbers(panel, [c for c, own in boxes if own == by], by).items()
            ]
    return portable(union(parts))


@query("a21_class_counts", """
SELECT n_classes, smallest, n_rows FROM (
  SELECT count(*) AS n_classes, min(n)::BIGINT AS smallest, sum(n)::BIGINT AS n_rows
  FROM (SELECT fatigue_label, count(*) AS n FROM brand_sales_panel GROUP BY ALL))""")
def _(t: Tables):
    counts = t.labelled("sales", "brand").groupBy("fatigue_label").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"), F.min("n").alias("smallest"), F.sum("n").alias("n_rows")
    )


_NUMERIC = {
    s: [w.split(":")[1] for w in FULL[s].split() if w[0] in "di" and not w.endswith(":product_id")]
    for s in SOURCE_NAMES
}


@query("a22_null_fractions", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS source, '{c}' AS \"column\", {r6(f'avg(({c} IS NULL)::INT)')} AS null_fraction FROM {s}_signals"
    for s in SOURCE_NAMES for c in _NUMERIC[s]
))
def _(t: Tables):
    return portable(union(
        summaries.null_fractions(t.signals(s), _NUMERIC[s]).select(F.lit(s).alias("source"), "*")
        for s in SOURCE_NAMES
    ))


@query("a23_dominant_fractions", "\nUNION ALL\n".join(
    f"SELECT 'usage' AS source, '{c}' AS \"column\", {r6('max(n) / sum(n)')} AS dominant_fraction "
    f"FROM (SELECT {c}, count(*)::DOUBLE AS n FROM usage_signals WHERE {c} IS NOT NULL GROUP BY ALL) "
    "HAVING count(*) > 0"
    for c in _NUMERIC["usage"]
))
def _(t: Tables):
    out = summaries.dominant_fractions(t.usage(), _NUMERIC["usage"])
    return portable(out.select(F.lit("usage").alias("source"), "*"))


@query("a24_train_medians", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, {r6(f'quantile_cont({c}, 0.5)')} AS median FROM brand_sales_train"
    for c in _NUMERIC["sales"]
))
def _(t: Tables):
    from ebbtide.operators import splits

    train, _ = splits.last_periods_split(t.sales("brand"), "month", 3)
    return portable(prep.medians(train, _NUMERIC["sales"]))


fragment("brand_sales_train", """
SELECT * FROM brand_sales_panel WHERE month NOT IN (
  SELECT month FROM (SELECT DISTINCT month FROM brand_sales_panel) ORDER BY month DESC LIMIT 3)""")
fragment("brand_sales_test", """
SELECT * FROM brand_sales_panel WHERE month IN (
  SELECT month FROM (SELECT DISTINCT month FROM brand_sales_panel) ORDER BY month DESC LIMIT 3)""")


@query("a27_log_profiles", """
SELECT 'sales' AS source, count(*) AS n_rows, count(DISTINCT "StockCode") AS n_products,
  count(DISTINCT "CustomerID") AS n_users, count(DISTINCT month) AS n_periods,
  strftime(min("InvoiceDate"), '%Y-%m-%d') AS first_day, strftime(max("InvoiceDate"), '%Y-%m-%d') AS last_day FROM sales_clean
UNION ALL SELECT 'reviews', count(*), count(DISTINCT "ProductId"), count(DISTINCT "UserId"), count(DISTINCT month),
  strftime(min(review_date), '%Y-%m-%d'), strftime(max(review_date), '%Y-%m-%d') FROM reviews_clean
UNION ALL SELECT 'usage', count(*), count(DISTINCT product_id), count(DISTINCT user_id), count(DISTINCT month),
  strftime(min(event_time), '%Y-%m-%d'), strftime(max(event_time), '%Y-%m-%d') FROM usage_clean""")
def _(t: Tables):
    sales = cleaning.clean_sales(t.sales_log()).withColumn("month", S.period_start(F.col("InvoiceDate")))
    reviews = cleaning.clean_reviews(t.reviews_log(), "TextKey").withColumn(
        "review_date", S.timestamp_from_unix(F.col("Time"))
    ).withColumn("month", S.period_start(F.col("review_date")))
    usage = cleaning.clean_events(t.usage_log()).withColumn(
        "month", S.period_start(F.col("event_time"), "week")
    )
    parts = (
        ("sales", sales, "StockCode", "InvoiceDate", "CustomerID"),
        ("reviews", reviews, "ProductId", "review_date", "UserId"),
        ("usage", usage, "product_id", "event_time", "user_id"),
    )
    return union(
        summaries.profile(df, product, moment, user, "month").select(F.lit(s).alias("source"), "*")
        for s, df, product, moment, user in parts
    )


# ----------------------------------------------------------------- T1..T3


@query("t1_rows_in_time_order", """
SELECT "StockCode", strftime(month, '%Y-%m-%d') AS month,
       row_number() OVER (PARTITION BY "StockCode" ORDER BY month) AS position FROM sales_aged""")
def _(t: Tables):
    w = Window.partitionBy("StockCode").orderBy("month")
    df = t.sales().select("StockCode", "month", F.row_number().over(w).alias("position"))
    return portable(df)


def _top_sql(source: str) -> str:
    spec = specs.SOURCES[source]
    return f"""SELECT "{spec.id_col}", count(*) AS n_declines FROM {source}_signals
WHERE {spec.decline_column} < {spec.decline_below} AND product_age_months >= {spec.decline_min_age}
GROUP BY ALL ORDER BY n_declines DESC, "{spec.id_col}" LIMIT 10"""


for _s in SOURCE_NAMES:
    fragment(f"{_s}_declining", _top_sql(_s))



@query("t2_declining_products", union_sql(
    "SELECT '{s}' AS source, {id}::VARCHAR AS product, n_declines FROM {s}_declining"
))
def _(t: Tables):
    parts = []
    for s in SOURCE_NAMES:
        spec = specs.SOURCES[s]
        top = summaries.declining_products(t.signals(s), spec)
        parts.append(top.select(
            F.lit(s).alias("source"), F.col(spec.id_col).cast("string").alias("product"), "n_declines"
        ))
    return union(parts)


@query("t3_decline_trajectories", union_sql(
    "SELECT '{s}' AS source, {id}::VARCHAR AS product, strftime(month, '%Y-%m-%d') AS month, "
    + r6("product_age_months") + " AS age, " + r6("{signal}") + " AS signal "
    "FROM {s}_signals JOIN {s}_declining USING ({id})"
))
def _(t: Tables):
    parts = []
    for s in SOURCE_NAMES:
        spec = specs.SOURCES[s]
        needed = dict.fromkeys([spec.id_col, "month", "product_age_months", spec.primary_signal, spec.decline_column])
        panel = stored(t.signals(s).select(*needed), f"trajectories-{s}")  # read for the top list and for its rows
        df = summaries.decline_trajectories(panel, spec)
        parts.append(df.select(
            F.lit(s).alias("source"), F.col(spec.id_col).cast("string").alias("product"), "month",
            F.col("product_age_months").alias("age"), F.col(spec.primary_signal).alias("signal"),
        ))
    return portable(union(parts))


# ----------------------------------------------------------------- U1..U3, J3


@query("u1_union_of_parts", """
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL""")
def _(t: Tables):
    from ebbtide.sources.readers import stack

    events = t["events"]
    early = events.where(F.dayofmonth("ts") <= 15)
    late = events.where(F.dayofmonth("ts") > 15)
    return stack([early, late]).groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users")
    )


@query("u2_union_of_summaries", union_sql(
    "SELECT '{s}' AS source, lifecycle_stage, count(*) AS n_rows FROM {s}_velocity GROUP BY ALL"
))
def _(t: Tables):
    return union(
        t.signals(s).groupBy("lifecycle_stage").agg(F.count("*").alias("n_rows")).select(
            F.lit(s).alias("source"), "*"
        )
        for s in SOURCE_NAMES
    )


_LEAKS = sorted(set(specs.LABEL_DERIVED_COLUMNS) & set(names(FULL["sales"])))


@query("u3_feature_set_differences", "\nUNION ALL\n".join(
    f"SELECT 'removed' AS kind, '{c}' AS name, count({c}) AS n_values FROM sales_panel" for c in _LEAKS
))
def _(t: Tables):
    panel = t.labelled("sales")
    removed = prep.feature_differences(panel.columns, prep.drop_leaky_columns(panel).columns)
    lost = [c for c in removed if c in specs.LABEL_DERIVED_COLUMNS]
    row = panel.agg(*[F.count(c).alias(c) for c in lost])
    return summaries.unpivot_row(row, {c: {"n_values": c} for c in lost}, "name").select(
        F.lit("removed").alias("kind"), "name", "n_values"
    )


@query("j3_rows_of_qualifying_products", """
SELECT "StockCode", count(*) AS n_rows FROM sales_aged WHERE "StockCode" IN (
  SELECT "StockCode" FROM sales_panel WHERE fatigue_label = 'high_fatigue') GROUP BY ALL""")
def _(t: Tables):
    panel = t.labelled("sales")
    hot = panel.where(F.col("fatigue_label") == specs.HIGH).select("StockCode").distinct()
    return panel.join(hot, "StockCode", "left_semi").groupBy("StockCode").agg(
        F.count("*").alias("n_rows")
    )


