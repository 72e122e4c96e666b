"""Read models over the labelled panels: distributions, coverage, quality and top lists."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators.quantiles import quantile_frame

def share_percent(condition: Column) -> Column:
    """Percentage of rows for which the condition holds."""
    return F.avg(condition.cast("double")) * 100


def label_distribution(panel: DataFrame) -> DataFrame:
    """Rows and share of each class; the total is summed over the few class rows."""
    counts = panel.groupBy("fatigue_label").agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("share", F.col("n_rows") / total * 100)


def fatigue_rate(panel: DataFrame) -> DataFrame:
    return panel.agg(share_percent(F.col("fatigue_label") != specs.HEALTHY).alias("fatigue_rate"))


def class_rates(panel: DataFrame) -> DataFrame:
    """One row: percentage of high, moderate and healthy rows."""
    label = F.col("fatigue_label")
    return panel.agg(
        share_percent(label == specs.HIGH).alias("high_rate"),
        share_percent(label == specs.MODERATE).alias("moderate_rate"),
        share_percent(label == specs.HEALTHY).alias("healthy_rate"),
    )


def label_statistics(
    panel: DataFrame, id_col: str, stats: Sequence[tuple[str, str]], digits: int = 3
) -> DataFrame:
    """Per class: the asked (column, mean|std|sum|median) values and the distinct products."""
    simple = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}
    aggs = [
        F.round(simple[kind](c).cast("double"), digits).alias(f"{c}_{kind}")
        for c, kind in stats
        if kind in simple
    ]
    out = panel.groupBy("fatigue_label").agg(*aggs, F.countDistinct(id_col).alias("n_products"))
    medians = [c for c, kind in stats if kind == "median"]
    if medians:
        exact = quantile_frame(
            panel, [(c, 0.5, f"{c}_median") for c in medians], ["fatigue_label"]
        )
        exact = exact.select(
            "fatigue_label", *[F.round(f"{c}_median", digits).alias(f"{c}_median") for c in medians]
        )
        out = out.join(F.broadcast(exact), "fatigue_label", "left")  # one row per class
    return out


def stage_by_label(panel: DataFrame) -> DataFrame:
    """Row-normalised percentages of the classes within each lifecycle stage."""
    label = F.col("fatigue_label")
    return panel.groupBy("lifecycle_stage").agg(
        *[share_percent(label == c).alias(c) for c in specs.CLASSES]
    )


def funnel_averages(panel: DataFrame) -> DataFrame:
    """Mean views, carts and purchases and the stage rates against views."""
    names = ("view_count", "cart_count", "purchase_count")
    means = panel.agg(*[F.avg(c).alias(c) for c in names])
    return means.select(
        *names,
        *[S.percent(F.col(c), F.col("view_count")).alias(f"{c}_rate") for c in names],
    )


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson coefficient of every column pair over the rows where both are present.

    Each task reduces its Arrow batches to one moment matrix per partition, so only
    columns x columns sums are shuffled however many rows there are.
    """
    cols = list(cols)
    values = df.select(*[S.finite_or_null(F.col(c)).alias(c) for c in cols]).persist()
    try:
        means = values.agg(*[F.avg(c) for c in cols]).collect()[0]
        moments = values.mapInPandas(_pair_moments([m or 0.0 for m in means]), _MOMENTS)
        totals = moments.groupBy("i", "j").agg(
            *[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")]
        )
        rows = totals.collect()  # one row per column pair
    finally:
        values.unpersist()
    found = {(r["i"], r["j"]): _pearson(r) for r in rows}
    table = [(a, b, found.get((i, j))) for (i, a), (j, b) in combinations(enumerate(cols), 2)]
    return df.sparkSession.createDataFrame(table, "a string, b string, r double")


_MOMENTS = "i int, j int, n double, si double, sj double, qi double, qj double, p double"


def _pair_moments(centers: Sequence[float]):
    """Per partition: pairwise-complete sums of the centred columns."""
    mu = np.asarray(centers, dtype=float)
    upper = np.triu_indices(len(mu), k=1)

    def run(batches):
        sums = None
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            seen = ~np.isnan(x)
            z, m = np.where(seen, x - mu, 0.0), seen.astype(float)
            part = np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
            sums = part if sums is None else sums + part
        if sums is not None:
            n, s, q, p = sums
            i, j = upper
            yield pd.DataFrame({
                "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j], "si": s[i, j],
                "sj": s[j, i], "qi": q[i, j], "qj": q[j, i], "p": p[i, j],
            })

    return run


def _pearson(row) -> float | None:
    n = row["n"]
    if n < 2:
        return None
    spread_i, spread_j = row["qi"] - row["si"] ** 2 / n, row["qj"] - row["sj"] ** 2 / n
    if spread_i <= 1e-12 * row["qi"] or spread_j <= 1e-12 * row["qj"]:
        return None
    return (row["p"] - row["si"] * row["sj"] / n) / (spread_i * spread_j) ** 0.5


def overview(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    month = F.date_format(spec.time_col, "yyyy-MM")
    return panel.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(panel.columns)).cast("bigint").alias("n_columns"),
        F.countDistinct(spec.id_col).alias("n_products"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
    ).select(F.lit(spec.title).alias("dataset"), "*")


def coverage(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    """Time span, distinct periods and average rows per period."""
    return panel.agg(
        F.date_format(F.min(spec.time_col), "yyyy-MM").alias("start"),
        F.date_format(F.max(spec.time_col), "yyyy-MM").alias("end"),
        F.countDistinct(spec.time_col).alias("n_periods"),
        F.count("*").alias("n_rows"),
    ).select(
        F.lit(spec.title).alias("dataset"), "start", "end", "n_periods",
        S.ratio(F.col("n_rows"), F.col("n_periods")).alias("rows_per_period"),
    )


def key_metrics(panel: DataFrame, spec: specs.SourceSpec) -> DataFrame:
    high = F.when(F.col("fatigue_label") == specs.HIGH, F.col(spec.id_col))
    return panel.agg(
        F.avg(spec.primary_signal).alias("avg_signal"),
        F.countDistinct(high).alias("high_fatigue_products"),
    ).select(
        F.lit(spec.title).alias("dataset"), F.lit(spec.dimension).alias("dimension"),
        F.lit(spec.primary_signal_title).alias("primary_signal"), "*",
    )


def profile(df: DataFrame, product: str, moment: str, user: str, period: str) -> DataFrame:
    """Size and span of a cleaned log."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(product).alias("n_products"),
        F.countDistinct(user).alias("n_users"),
        F.countDistinct(period).alias("n_periods"),
        F.date_format(F.min(moment), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(moment), "yyyy-MM-dd").alias("last_day"),
    )


def unpivot_row(row: DataFrame, parts: dict[str, dict[str, str]], key: str = "column") -> DataFrame:
    """A one-row frame of wide aggregates as one row per ``parts`` entry."""
    items = F.array(*[
        F.struct(F.lit(name).alias(key), *[F.col(src).alias(out) for out, src in cols.items()])
        for name, cols in parts.items()
    ])
    return row.select(F.inline(items))


def column_quality(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, non-finite values and whether it is entirely null."""
    floating = set(S.numeric_columns(df))
    aggs, parts = [F.count("*").alias("n")], {}
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        aggs.append(F.count_if(col.isNull()).alias(f"n{i}"))
        bad = F.lit(False)
        if c in floating:
            d = col.cast("double")
            bad = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
        aggs.append(F.count_if(bad).alias(f"i{i}"))
        parts[c] = {"n_rows": "n", "n_null": f"n{i}", "n_non_finite": f"i{i}"}
    table = unpivot_row(df.agg(*aggs), parts)
    return table.withColumn("all_null", F.col("n_null") == F.col("n_rows"))


def null_fractions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return unpivot_row(row, {c: {"null_fraction": c} for c in cols})


def dominant_fractions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: the share of its most frequent non-null value (counts combine map-side)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    return counts.groupBy("column").agg(
        (F.max("n") / F.sum("n")).alias("dominant_fraction")
    )


def histogram(df: DataFrame, col: str, bins: int, log_scale: bool = False) -> DataFrame:
    """Rows per equal-width bin between the extremes; the top edge belongs to the last bin."""
    value = F.col(col).cast("double")
    if log_scale:
        df, value = df.where(value > 0), F.log10(value)
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    ends = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    place = F.floor(S.ratio(F.col("v") - lo, hi - lo) * bins)
    index = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0))
    return values.groupBy(index.cast("bigint").alias("bin")).agg(F.count("*").alias("n_rows"))


NUMBERS = (("minimum", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1.0))


def five_numbers(df: DataFrame, cols: Sequence[str], by: str) -> dict[str, DataFrame]:
    """Minimum, quartiles and maximum per group of each column, all found in the same scans."""
    wide = quantile_frame(df, [(c, p, f"{c}_{name}") for c in cols for name, p in NUMBERS], [by])
    return {c: wide.select(by, *[F.col(f"{c}_{name}").alias(name) for name, _ in NUMBERS]) for c in cols}


def declining_products(panel: DataFrame, spec: specs.SourceSpec, k: int = 10) -> DataFrame:
    """Products with the most declining periods; ties by id."""
    return (
        panel.where(
            (F.col(spec.decline_column) < spec.decline_below)
            & (F.col("product_age_months") >= spec.decline_min_age)
        )
        .groupBy(spec.id_col)
        .agg(F.count("*").alias("n_declines"))
        .orderBy(F.desc("n_declines"), spec.id_col)
        .limit(k)
    )


def decline_trajectories(panel: DataFrame, spec: specs.SourceSpec, k: int = 10) -> DataFrame:
    """All periods of the most declining products."""
    top = declining_products(panel, spec, k)
    return panel.join(F.broadcast(top), spec.id_col)  # at most k rows


def event_trend(events: DataFrame) -> DataFrame:
    return events.groupBy(
        F.date_format("event_time", "yyyy-MM").alias("year_month"), "event_type"
    ).agg(F.count("*").alias("n_events"))
