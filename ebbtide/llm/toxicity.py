"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are a document's distinct lower-cased tokens and their first four to eight letters, hashed. Of the
features of a labelled sample, those that toxic documents hold far more often are screened. One weight vector
over them is shared by the ordered thresholds: ``P(grade >= k) = sigmoid(score - threshold_k)``. The outputs are
those probabilities and the expected severity, their sum.

``labels`` may hold grades. A 0/1 label is refined for training: toxic documents of the sample get grade 1 to 3
by how many screened features they hold, a third each.

The model is fitted on at most ``sample`` labelled documents, taken in the order of a hash of their ids; their
screened features (not their texts) are what the driver holds. Every document is scored whole.

Defined results: a null or empty text holds no feature and has the least score; labels that are null or
contradict each other are not used; without labels of both kinds nothing is toxic; repeated rows are scored
each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import bounded_batches, stored
from ebbtide.llm.quality import labelled_sample

SAMPLE = 20_000
FEATURES = 4096
#: Log-likelihood ratio of a feature's share of toxic documents against the sample's; among a million features
#: of clean documents about one gets as far by chance.
GAIN = 13.0
#: Least share of toxic documents among those that hold a feature.
PURE = 0.8
GRADES = 3
EDGE = ".,;:!?\"'()[]{}<>*_-`~|/\\#$%&+="
KNOWN = 100_000
BATCH_DOCS = 256


def token_features(word: str) -> list[int]:
    """Hashes of a token and its beginnings."""
    token = word.lower().strip(EDGE)
    if not token:
        return []
    parts = ["w" + token, *("p" + token[:k] for k in range(4, 9) if len(token) > k)]
    return [xxhash.xxh32_intdigest(p) for p in parts]


class Weights(dict):
    """Summed weight of a word's features, remembered for frequent words."""

    def __init__(self, ids: list[int], weights: list[float]):
        super().__init__()
        self.by_feature = dict(zip(ids, weights, strict=True))

    def __missing__(self, word: str) -> float:
        value = sum(self.by_feature.get(f, 0.0) for f in token_features(word))
        if len(self) < KNOWN:
            self[word] = value
        return value


@dataclass
class Model:
    ids: list[int]
    weights: list[float]
    thresholds: list[float]


def fit_ordinal(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int,
    levels: int = GRADES, ridge: float = 1e-6, rounds: int = 4000, rate: float = 0.2,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the cumulative-link likelihood (Adam on sparse rows)."""
    n = len(grade)
    shares = [np.clip((grade >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, levels + 1)]
    start = np.maximum.accumulate([-np.log(s / (1 - s)) for s in shares])
    free = np.r_[np.zeros(n_features), start[0], np.log(np.maximum(np.diff(start), 0.1))]
    first, second = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, rounds + 1):
        weights, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        cuts = np.r_[-np.inf, free[n_features] + np.r_[0.0, np.cumsum(gaps)], np.inf]
        s = np.bincount(row, weights=value * weights[column], minlength=n)
        upper, lower = _sigmoid(cuts[grade + 1] - s), _sigmoid(cuts[grade] - s)
        inside = np.maximum(upper - lower, 1e-9)
        at_upper, at_lower = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        by_score = -(at_upper - at_lower)
        by_cut = np.bincount(grade + 1, weights=at_upper, minlength=levels + 2) - np.bincount(grade, weights=at_lower, minlength=levels + 2)
        by_cut = by_cut[1 : levels + 1]
        gradient = np.r_[
            np.bincount(column, weights=value * by_score[row], minlength=n_features) / n - ridge * weights,
            by_cut.sum() / n, [by_cut[k:].sum() / n * gaps[k - 1] for k in range(1, levels)],
        ]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = rate * min(1.0, 2 * (1 - t / rounds))
        free = free + step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return free[:n_features], free[n_features] + np.r_[0.0, np.cumsum(np.exp(free[n_features + 1 :]))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, levels: int = GRADES) -> Model:
    bounded_batches(docs)
    chosen = F.broadcast(labelled_sample(labels, "toxic", sample))  # ``sample`` ids at most
    read = docs.select("doc_id", "text").join(chosen, "doc_id")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                found = [
                    np.unique([f for w in set(t.split()) for f in token_features(w)], return_counts=True)
                    for t in part.column(1).to_pylist()
                ]
                yield pa.record_batch({
                    "doc_id": part.column(0), "y": part.column(2),
                    "f": pa.array([f.astype("int64") for f, _ in found], pa.list_(pa.int64())),
                    "c": pa.array([c.astype("int32") for _, c in found], pa.list_(pa.int32())),
                })

    features_of = read.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y")
    ).mapInArrow(held, "doc_id long, y int, f array<bigint>, c array<int>")
    # of several texts of one id, the least by its features: the same in every run
    rows = features_of.groupBy("doc_id").agg(F.min(F.struct("f", "c", "y")).alias("row")).select("doc_id", "row.*")
    rows = stored(rows, "toxicity-sample")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    none = Model([], [], [float(k) for k in range(5, 5 + levels)])
    if not bad or not good:
        return none
    holds = rows.select((F.col("y") > 0).cast("int").alias("toxic"), F.explode("f").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    rate, a, b, n = bad / (bad + good), F.col("a"), F.col("b"), F.col("a") + F.col("b")
    gain = a * F.log(F.greatest(a, F.lit(1)) / (n * rate)) + b * F.log(F.greatest(b, F.lit(1)) / (n * (1 - rate)))
    screened = stored(
        holds.withColumn("gain", gain).filter((F.col("gain") >= GAIN) & (a >= PURE * n))
        .orderBy(F.desc("gain"), "f").limit(features).select("f"),
        "toxicity-features",
    )
    ids = sorted(r["f"] for r in screened.collect())
    if not ids:
        return none
    entries = rows.select("doc_id", F.explode(F.arrays_zip("f", "c")).alias("x")).select("doc_id", "x.f", "x.c").join(
        F.broadcast(screened), "f"  # ``features`` rows at most
    ).toPandas()
    known = rows.select("doc_id", "y").toPandas().sort_values("doc_id", ignore_index=True)
    row = np.searchsorted(known["doc_id"].to_numpy(), entries["doc_id"].to_numpy())
    column = np.searchsorted(np.array(ids), entries["f"].to_numpy())
    value = entries["c"].to_numpy(dtype=float)
    grade = known["y"].to_numpy(dtype=np.int64)
    if grade.max() <= 1 < levels:
        grade = refined(grade, np.bincount(row, weights=value, minlength=len(known)), levels)
    weights, thresholds = fit_ordinal(row, column, value, np.minimum(grade, levels), len(ids), levels)
    return Model(ids, weights.tolist(), thresholds.tolist())


def refined(toxic: np.ndarray, held: np.ndarray, levels: int) -> np.ndarray:
    """Grades 1 to ``levels`` for toxic documents, by the quantiles of how many screened features they hold."""
    cuts = np.quantile(held[toxic > 0], [k / levels for k in range(1, levels)])
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, held, side="right"), 0)


def severity_score(text: Column, model: Model) -> Column:
    """Linear score of a text: the weights of its distinct words."""

    @F.arrow_udf("double")
    def linear(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(model.ids, model.weights)
        for batch in batches:
            scores: list[float] = []
            for start in range(0, len(batch), BATCH_DOCS):
                texts = batch.slice(start, BATCH_DOCS).to_pylist()
                scores += [sum(map(weights.__getitem__, set(t.split()))) for t in texts]
            yield pa.array(scores, pa.float64())

    return linear(F.coalesce(text, F.lit("")))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, p_1 .. p_K (probability of at least that grade), expected_severity, severity and toxic.

    ``severity`` is the highest grade that is more likely reached than not, ``toxic`` that there is one.
    """
    scored = docs.select("doc_id", severity_score(F.col("text"), model).alias("score"))
    levels = range(1, len(model.thresholds) + 1)
    reached = [1 / (1 + F.exp(F.lit(t) - F.col("score"))) for t in model.thresholds]
    result = scored.select("doc_id", "score", *[p.alias(f"p_{k}") for k, p in zip(levels, reached, strict=True)])
    columns = [F.col(f"p_{k}") for k in levels]
    return result.withColumn("expected_severity", sum(columns[1:], columns[0])).withColumn(
        "severity", sum(((p >= 0.5).cast("int") for p in columns[1:]), (columns[0] >= 0.5).cast("int"))
    ).withColumn("toxic", F.col("severity") > 0)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, all their columns."""
    if not model.thresholds:
        return docs
    return docs.filter(severity_score(F.col("text"), model) < model.thresholds[0])
