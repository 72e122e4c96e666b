"""Expressions on per-row class-probability arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide import specs

REVIEW_BELOW_PROBABILITY = 0.60
REVIEW_BELOW_MARGIN = 0.15
OVERCONFIDENT_ABOVE = 0.97


def arg_max(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_at(index: Column, classes: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index + 1)


def top_probability(p: Column) -> Column:
    return F.array_max(p)


def margin(p: Column) -> Column:
    """Gap between the two largest probabilities; 1 when there is only one class."""
    ordered = F.sort_array(p, asc=False)
    return F.when(F.size(p) < 2, F.lit(1.0)).otherwise(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "high").when(confidence >= 0.60, "medium").otherwise("low")


def needs_review(p: Column) -> Column:
    return (top_probability(p) < REVIEW_BELOW_PROBABILITY) | (margin(p) < REVIEW_BELOW_MARGIN)


def decide(
    p: Column,
    classes: Sequence[str],
    weights: Mapping[str, float] | None = None,
    threshold: float = 0.5,
    positive: str = specs.FATIGUED,
) -> Column:
    """Class name: thresholded P(positive) for two classes, weighted arg-max otherwise."""
    if len(classes) == 2:
        at = list(classes).index(positive)
        other = classes[1 - at]
        return F.when(F.get(p, F.lit(at)) >= threshold, positive).otherwise(other)
    weights = weights or {}
    factor = F.array(*[F.lit(float(weights.get(c, 1.0))) for c in classes])
    return class_at(arg_max(F.zip_with(p, factor, lambda a, b: a * b)), classes)


def risk_score(predicted: Column, confidence: Column) -> Column:
    """0..100 risk from class and confidence; the binary positive class ranks as moderate."""
    raw = (
        F.when(predicted.contains("high"), 72 + confidence * 28)
        .when(predicted.contains("moderate") | (predicted == specs.FATIGUED), 45 + confidence * 24)
        .otherwise(10 + (1 - confidence) * 18)
    )
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2)


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 70, "High Fatigue").when(score >= 40, "Moderate Fatigue").otherwise("Healthy")
    )


def score_interval(score: Column, confidence: Column) -> tuple[Column, Column]:
    """Score -/+ 12 points scaled by the missing confidence, kept in [0, 100]."""
    spread = (1 - confidence) * 12
    return F.greatest(score - spread, F.lit(0.0)), F.least(score + spread, F.lit(100.0))


def brier(p: Column, actual_index: Column) -> Column:
    """Squared distance between the probabilities and the one-hot truth."""
    onehot = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == actual_index).cast("double"))
    diff = F.zip_with(p, onehot, lambda a, b: (a - b) * (a - b))
    return F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v)


def reliability_bin(confidence: Column, n_bins: int = 10) -> Column:
    """Bin index by comparison with the exact edges i * (1/n); the last bin is closed."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    return F.size(F.filter(edges, lambda e: e <= confidence))
