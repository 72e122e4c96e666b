"""Feature stability: dead and duplicate columns, ratio capping, age-normalised deviations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators import summaries
from ebbtide.operators.quantiles import quantile_values
from ebbtide.session import cut_lineage, stored


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not keys."""
    return [c for c in S.numeric_columns(df) if c not in specs.ID_TIME_TARGET_COLUMNS]


def dead_columns(
    df: DataFrame, cols: Sequence[str], max_null: float = 0.95, max_constant: float = 0.99
) -> DataFrame:
    """(column) rows that are mostly null or dominated by one value; the columns are stored once for both tests."""
    df = stored(df.select(*cols), "dead-columns")
    empty = summaries.null_fractions(df, cols).where(F.col("null_fraction") > max_null)
    constant = summaries.dominant_fractions(df, cols).where(
        F.col("dominant_fraction") > max_constant
    )
    return empty.select("column").union(constant.select("column")).distinct()


def correlated_columns(df: DataFrame, cols: Sequence[str], above: float = 0.98) -> DataFrame:
    """(column) rows that correlate beyond the bound with any earlier column."""
    pairs = summaries.correlations(df, cols)
    return pairs.where(F.abs("r") > above).select(F.col("b").alias("column")).distinct()


def listed(names: DataFrame, cols: Sequence[str]) -> list[str]:
    """Column names of a schema decision, in feature order."""
    found = {r["column"] for r in names.collect()}
    return [c for c in cols if c in found]


def ratio_columns(cols: Sequence[str]) -> list[str]:
    return [c for c in cols if any(part in c for part in specs.RATIO_FRAGMENTS)]


def cap_bounds(
    df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99
) -> dict[str, tuple[float | None, float | None]]:
    values = quantile_values(df, [(c, p) for c in cols for p in (low, high)], hold=True)
    return {c: (values[(c, low)], values[(c, high)]) for c in cols}


def cap(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clip to the bounds, keeping NULL."""
    limits = {c: b for c, b in bounds.items() if b[0] is not None}
    return df.select(*[
        S.clip(F.col(c), *limits[c]).alias(c) if c in limits else F.col(c) for c in df.columns
    ])


def age_stage(df: DataFrame, age_col: str = "product_age_months"):
    """Stage from 0, 3, 12 and 24 months; a negative age belongs to none."""
    age = F.col(age_col)
    return F.when(age >= 0, S.lifecycle_stage(age, (3, 12, 24)))


def age_deviations(
    df: DataFrame,
    cols: Sequence[str],
    age_col: str = "product_age_months",
    category_col: str | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Add ``{col}_age_dev``: distance from the stage mean in stage deviations.

    Statistics are aggregated per stage and joined back, so that a stage holding most rows is
    never gathered in one task. A zero deviation counts as 1.
    """
    cols = [c for c in cols if c in df.columns]
    if age_col not in df.columns or not cols:
        return df
    stage = age_stage(df, age_col)
    keyed_by_category = category_col is not None and category_col in df.columns
    if keyed_by_category:
        stage = F.concat_ws("_", F.coalesce(stage, F.lit("nan")), F.col(category_col).cast("string"))
    fitted = (fit_on if fit_on is not None else df).withColumn("_stage", stage)
    stats = fitted.where(F.col("_stage").isNotNull()).groupBy("_stage").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]
    )
    if not keyed_by_category:
        stats = F.broadcast(stats)  # four stages
    joined = df.withColumn("_stage", stage).join(stats, "_stage", "left")
    deviations = [
        (
            (F.col(c) - F.col(f"_m_{c}"))
            / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        ).alias(f"{c}_age_dev")
        for c in cols
    ]
    return joined.select(*df.columns, *deviations)


def stabilise(
    df: DataFrame, spec: specs.SourceSpec, fit_on: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """All fixes in order; returns the frame and a (step, column) report.

    With ``fit_on`` the dropped columns, caps and stage statistics come from those rows only.
    """
    spark = df.sparkSession
    df = cut_lineage(S.nullify_non_finite(df))
    base = S.nullify_non_finite(fit_on) if fit_on is not None else df
    cols = feature_columns(df)
    dead = listed(dead_columns(base, cols), cols)
    cols = [c for c in cols if c not in dead]
    twins = listed(correlated_columns(base, cols), cols)
    cols = [c for c in cols if c not in twins]
    df, base = df.drop(*dead, *twins), base.drop(*dead, *twins)
    bounds = cap_bounds(base, ratio_columns(cols))
    df, base = cap(df, bounds), cap(base, bounds)
    if "product_age_months" in cols:
        df = age_deviations(df, spec.age_dev_columns, fit_on=base if fit_on is not None else None)
    report = [("dead", c) for c in dead] + [("correlated", c) for c in twins]
    report += [("capped", c) for c in bounds]
    return df, spark.createDataFrame(report, "step string, column string")
