"""Probability calibration on held-out rows: one map per class, then renormalised.

Isotonic maps are pooled where the rows are: equal scores are added up, score ranges pool their adjacent violators,
and only the blocks left (for n rows of 0 and 1 in the order of n^(2/3) at most, as their means strictly increase)
go to Spark's fit. Rows pooled inside a range stay together in the whole solution, so the map is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISOTONIC_ROWS_PER_CLASS = 50


@dataclass(frozen=True)
class Calibrator:
    method: str
    classes: tuple[str, ...]
    maps: tuple[Any, ...]

    def apply(self, df: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
        """Add the calibrated probability array."""
        cols = list(df.columns)
        for i, m in enumerate(self.maps):
            scored = df.withColumn("_score", F.get(F.col(p), F.lit(i)))
            if self.method == "sigmoid":
                scored = VectorAssembler(inputCols=["_score"], outputCol="_x").transform(scored)
                mapped = m.transform(scored)
                value = F.get(vector_to_array("_prob"), F.lit(1))
            else:
                mapped, value = m.transform(scored), F.col("_iso")
            keep = [c for c in df.columns if c not in ("_score",)]
            df = mapped.select(*keep, value.alias(f"_c{i}"))
        parts = [F.col(f"_c{i}") for i in range(len(self.maps))]
        total = sum(parts[1:], parts[0])
        even = F.lit(1.0 / len(parts))
        normal = F.array(*[F.when(total > 0, c / total).otherwise(even) for c in parts])
        return df.select(*cols, normal.alias(out))


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of ascending scores whose shares of hits strictly increase; counts are whole numbers, so exact."""
    blocks: list[tuple[float, float, int, int]] = []
    for batch in batches:
        for score, n, hits in zip(batch["score"].tolist(), batch["n"].tolist(), batch["hits"].tolist(), strict=True):
            low = score
            while blocks and blocks[-1][3] * n >= hits * blocks[-1][2]:
                low, _, more, more_hits = blocks.pop()
                n, hits = n + more, hits + more_hits
            blocks.append((low, score, n, hits))
    yield pd.DataFrame(blocks, columns=["low", "high", "n", "hits"])


def isotonic_blocks(rows: DataFrame, score: str, hit: str) -> DataFrame:
    """(low, high, n, hits) of the blocks of each score range; rows without a score are left out, hits are 0 or 1."""
    value = F.col(score).cast("double")
    counted = rows.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(hit).cast("bigint")).alias("hits")
    )
    ranges = counted.repartitionByRange("score").sortWithinPartitions("score")
    return ranges.mapInPandas(_pool, "low double, high double, n bigint, hits bigint")


def fit_isotonic(rows: DataFrame, score: str, hit: str) -> Any:
    """Spark's isotonic model of all rows, fitted on the blocks: a block counts half at each of its ends."""
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    points = isotonic_blocks(rows, score, hit).select(
        F.explode(ends).alias(score), (F.col("hits") / F.col("n")).alias(hit), (F.col("n") / F.size(ends)).alias("_weight")
    )
    return IsotonicRegression(featuresCol=score, labelCol=hit, weightCol="_weight", predictionCol="_iso").fit(points)


def fit_calibrator(
    df: DataFrame, classes: Sequence[str], method: str = "isotonic", p: str = "p", y: str = "_class"
) -> Calibrator:
    """Fit on held-out rows; isotonic falls back to sigmoid when there are too few rows."""
    if method == "isotonic" and df.count() < ISOTONIC_ROWS_PER_CLASS * len(classes):
        method = "sigmoid"
    maps = []
    for i, c in enumerate(classes):
        rows = df.select(
            F.get(F.col(p), F.lit(i)).alias("_score"), (F.col(y) == c).cast("double").alias("_hit")
        )
        if method == "sigmoid":
            rows = VectorAssembler(inputCols=["_score"], outputCol="_x").transform(rows)
            model = LogisticRegression(
                featuresCol="_x", labelCol="_hit", probabilityCol="_prob", rawPredictionCol="_raw",
                predictionCol="_pred",
            ).fit(rows)
        else:
            model = fit_isotonic(rows, "_score", "_hit")
        maps.append(model)
    return Calibrator(method, tuple(classes), tuple(maps))
