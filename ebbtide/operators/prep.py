"""Leakage-safe feature preparation, fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators import history, labels, splits, stability, summaries
from ebbtide.operators.quantiles import quantile_values
from ebbtide.session import cut_lineage


def drop_leaky_columns(df: DataFrame) -> DataFrame:
    """Without identifiers, times, target, global z-scores and label-derived columns."""
    return df.drop(
        *specs.ID_TIME_TARGET_COLUMNS, *specs.GLOBAL_Z_COLUMNS, *specs.LABEL_DERIVED_COLUMNS
    )


def feature_differences(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """Names lost between two feature sets, in their original order."""
    kept = set(after)
    return [c for c in before if c not in kept]


def medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, median) of each column over its non-null training values."""
    values = quantile_values(train, [(c, 0.5) for c in cols], hold=True)
    rows = [(c, values[(c, 0.5)]) for c in cols]
    return train.sparkSession.createDataFrame(rows, "name string, median double")


def mostly_null(train: DataFrame, cols: Sequence[str], above: float = 0.99) -> list[str]:
    """Columns that are null in nearly all training rows."""
    table = summaries.null_fractions(train, cols).where(F.col("null_fraction") > above)
    return stability.listed(table, cols)


def impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Training median for NULL, 0 where there is no median."""
    return df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(values[c] if values[c] is not None else 0.0)).alias(c)
        if c in values else F.col(c)
        for c in df.columns
    ])


def categories(train: DataFrame, col: str) -> list[str]:
    """Sorted training categories; for columns of a closed list of values such as the lifecycle stage."""
    rows = train.select(F.coalesce(F.col(col), F.lit("Unknown"))).distinct().collect()
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Indicator columns ``{col}_{value}``; an unknown category is all zeros."""
    given = F.coalesce(F.col(col), F.lit("Unknown"))
    flags = [(given == v).cast("double").alias(f"{col}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != col], *flags)


def scale_parameters(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column; a zero deviation counts as 1."""
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).collect()[0]
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, parameters: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        ((F.col(c) - parameters[c][0]) / parameters[c][1]).alias(c) if c in parameters else F.col(c)
        for c in df.columns
    ])


def label_codes(train: DataFrame, label: str) -> list[str]:
    """Classes in code order: alphabetical, from the training rows."""
    return sorted(r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().collect())


def encode_label(df: DataFrame, label: str, classes: Sequence[str], out: str = "label") -> DataFrame:
    codes = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, (F.array_position(codes, F.col(label)) - 1).cast("double"))


KEYS = ("_id", "_period", "_class")


@dataclass(frozen=True)
class Prepared:
    """Fitted preparation: scaled frames, feature order and everything needed to score rows."""

    train: DataFrame
    test: DataFrame
    features: tuple[str, ...]
    classes: tuple[str, ...]
    medians: dict[str, float | None]
    scaling: dict[str, tuple[float, float]]
    stages: tuple[str, ...]
    dropped: dict[str, tuple[str, ...]]

    def artifacts(self) -> DataFrame:
        """One row per feature: position, median, mean, deviation."""
        rows = [
            (i, c, self.medians.get(c), *map(float, self.scaling[c])) for i, c in enumerate(self.features)
        ]
        schema = "position int, name string, median double, mean double, std double"
        return self.train.sparkSession.createDataFrame(rows, schema)

    def align(self, rows: DataFrame) -> DataFrame:
        """Raw rows in model feature order: absent or NULL inputs take median, mean or 0."""
        out = rows
        if self.stages and "lifecycle_stage" in rows.columns:
            out = out.withColumn("lifecycle_stage", F.lower(F.trim("lifecycle_stage")))
            out = one_hot(out.drop(*[c for c in self.features if c.startswith("lifecycle_stage_")]),
                          "lifecycle_stage", self.stages)
        have = set(out.columns)
        cols = []
        for c in self.features:
            default = self.medians.get(c)
            if default is None:
                default = self.scaling[c][0] if c in self.scaling else 0.0
            value = F.coalesce(S.finite_or_null(F.col(c)), F.lit(default)) if c in have else F.lit(default)
            mean, std = self.scaling[c]
            cols.append(((value - mean) / std).alias(c))
        keep = [c for c in out.columns if c not in self.features]
        return assemble(out.select(*keep, *cols), self.features)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def prepare(
    panel: DataFrame,
    spec: specs.SourceSpec,
    forward: bool = False,
    horizon: int = 4,
    binary: bool = False,
    walk_forward: bool = True,
    test_periods: int = 2,
    test_frac: float = 0.2,
) -> Prepared:
    """Labelled panel to scaled train and test frames with a ``features`` vector and ``label``.

    Everything that is fitted (labels' cut points aside, which follow the panel) uses training
    rows only; rows keep their key in ``_id`` and ``_period`` and their class in ``_class``.
    """
    df = history.derived_features(panel, spec).dropna(subset=["fatigue_label"])
    df = history.history_features(df, spec)
    if forward:
        df = labels.forward_labels(df, spec, horizon, binary=binary)
    else:
        if spec.name == "usage":
            df = labels.usage_severity(df)
        if binary:
            df = df.withColumn("fatigue_label", labels.binary_label(F.col("fatigue_label")))
    df = cut_lineage(S.nullify_non_finite(df))
    if walk_forward:
        train, test = splits.last_periods_split(df, spec.time_col, test_periods)
    else:
        train, test = splits.per_product_split(df, spec.id_col, spec.time_col, test_frac)
    if splits.needs_fallback(train, "fatigue_label"):
        train, test = splits.stratified_split(
            df, "fatigue_label", [spec.id_col, spec.time_col], test_frac
        )
    classes = label_codes(train, "fatigue_label")

    def keyed(part: DataFrame) -> DataFrame:
        part = part.withColumns({
            "_id": F.col(spec.id_col).cast("string"),
            "_period": F.col(spec.time_col),
            "_class": F.col("fatigue_label"),
        })
        return drop_leaky_columns(part)

    test = splits.seen_labels(test, train, "fatigue_label")
    train, test = keyed(train), keyed(test)
    numeric = [c for c in S.numeric_columns(train) if c not in KEYS]
    empty = mostly_null(train, numeric)
    numeric = [c for c in numeric if c not in empty]
    train, test = train.drop(*empty), test.drop(*empty)
    middle = quantile_values(train, [(c, 0.5) for c in numeric], hold=True)
    middle = {c: middle[(c, 0.5)] for c in numeric}
    train, test = impute(train, middle), impute(test, middle)
    twins = stability.listed(stability.correlated_columns(train, numeric), numeric)
    numeric = [c for c in numeric if c not in twins]
    train, test = train.drop(*twins), test.drop(*twins)
    stages: list[str] = []
    if "lifecycle_stage" in train.columns:
        stages = categories(train, "lifecycle_stage")
        train = one_hot(train, "lifecycle_stage", stages)
        test = one_hot(test, "lifecycle_stage", stages)
    features = [*numeric, *[f"lifecycle_stage_{s}" for s in stages]]
    scaling = scale_parameters(train, features)
    frames = []
    for part in (train, test):
        out = assemble(scale(part, scaling), features)
        frames.append(encode_label(out, "_class", classes))
    return Prepared(
        train=frames[0], test=frames[1], features=tuple(features), classes=tuple(classes),
        medians={c: middle[c] for c in numeric}, scaling=scaling, stages=tuple(stages),
        dropped={"mostly_null": tuple(empty), "correlated": tuple(twins)},
    )


def replace_frames(prepared: Prepared, train: DataFrame, test: DataFrame) -> Prepared:
    """The same fitted preparation over stored frames."""
    return replace(prepared, train=train, test=test)
