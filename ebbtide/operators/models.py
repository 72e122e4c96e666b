"""Training, model choice and clustering with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import probability as P
from ebbtide.operators import balancing, boosting, metrics, newton, trees
from ebbtide.session import cut_lineage

# ---- fixed values: hyper-parameter grids of the three classifiers ----
GRIDS: dict[str, dict[str, Sequence[Any]]] = {
    "boosted_trees": {
        "maxIter": (200, 400), "maxDepth": (4, 6), "stepSize": (0.05, 0.1), "regAlpha": (0.0, 0.1), "regLambda": (1.0, 3.0),
    },
    "random_forest": {"numTrees": (200, 400), "maxDepth": (10, 20), "minInstancesPerNode": (1, 4)},
    "logistic_regression": {"C": (0.01, 0.1, 1.0, 10.0)},
}
# ---- end of fixed values ----


@dataclass(frozen=True)
class Classifier:
    """Fitted models and the class order of their probabilities."""

    kind: str
    classes: tuple[str, ...]
    models: tuple[Any, ...]
    params: Mapping[str, Any] = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Add the probability array ``out`` (class order) and ``pred``."""
        if self.kind == "boosted_trees":
            scored = self.models[0].predict(df, out)
        elif len(self.models) == 1:
            p = _apply(df, self.models[0], "_p0")
            scored = p.withColumn(out, F.col("_p0")).drop("_p0")
        else:
            scored = df
            for i, m in enumerate(self.models):
                scored = _apply(scored, m, f"_p{i}")
            ones = [F.get(F.col(f"_p{i}"), F.lit(1)) for i in range(len(self.models))]
            total = sum(ones[1:], ones[0])
            even = F.lit(1.0 / len(ones))
            scored = scored.withColumn(
                out, F.array(*[F.when(total > 0, o / total).otherwise(even) for o in ones])
            ).drop(*[f"_p{i}" for i in range(len(self.models))])
        return scored.withColumn("pred", P.class_at(P.arg_max(F.col(out)), self.classes))

    def importances(self, features: Sequence[str]) -> list[tuple[str, float]]:
        """Feature weights, largest first: impurity gains, or absolute coefficients."""
        if self.kind == "logistic_regression":
            rows = self.models[0].coefficientMatrix.toArray()
            weights = abs(rows).mean(axis=0)
        elif self.kind == "boosted_trees":
            weights = self.models[0].ensemble.importances(len(features))
        else:
            weights = sum(m.featureImportances.toArray() for m in self.models) / len(self.models)
        return sorted(zip(features, map(float, weights), strict=True), key=lambda x: -x[1])

    def classify(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function of a matrix of features that gives the code of each row's class, for use inside tasks."""
        if self.kind == "logistic_regression":
            weights, shift = self.models[0].coefficientMatrix.toArray(), np.array(self.models[0].interceptVector.toArray())
        else:
            ensemble = self.ensemble()
        two = self.kind in ("logistic_regression", "boosted_trees") and len(self.classes) == 2

        if self.kind == "logistic_regression":  # the functions take no fitted Spark model along
            return lambda x: _codes(x @ weights.T + shift, two)
        return lambda x: _codes(np.concatenate([ensemble.score(p) for p in trees.slices(x, ensemble)]), two)

    def ensemble(self) -> trees.Ensemble:
        """The node table of a tree classifier."""
        if self.kind == "boosted_trees":
            return self.models[0].ensemble
        if self.kind in ("random_forest", "decision_tree"):
            return trees.of_forest(self.models[0])
        raise ValueError(f"{self.kind} has no trees")

    def explain(self, df: DataFrame, features: Sequence[str], k: int = trees.TOP, out: str = "top_features") -> DataFrame:
        """Add every row's ``k`` features of largest mean absolute contribution, as (feature, value).

        Along the trees' paths for tree classifiers; coefficient times value for the logistic one.
        """
        if self.kind == "logistic_regression":
            rows = self.models[0].coefficientMatrix.toArray()
            parts = F.array(*[
                F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w) for row in rows
            ])
            return df.withColumn(out, trees.strongest(parts, features, k))
        told = trees.contributions(df, self.ensemble(), "_contributions")
        return told.withColumn(out, trees.strongest(F.col("_contributions"), features, k)).drop("_contributions")


def _codes(margins: np.ndarray, two: bool) -> np.ndarray:
    return (margins[:, 0] > 0).astype(int) if two else margins.argmax(axis=1)


def _apply(df: DataFrame, model: Any, out: str) -> DataFrame:
    keep = [c for c in df.columns if c not in ("rawPrediction", "probability", "prediction")]
    return model.transform(df.select(*keep)).select(
        *keep, vector_to_array("probability").alias(out)
    )


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class)."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for code, n in counts.items():
        weight = F.when(F.col(label) == code, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("weight", weight)


#: Fits on more rows run one at a time: they fill a cluster, and the driver holds every forest that grows.
SMALL_ROWS = 1 << 13


def at_once(rows: DataFrame) -> int:
    """How many fits on such rows may run at the same time."""
    return 4 if rows.count() <= SMALL_ROWS else 1


def in_parallel(work: Callable[[Any], Any], items: Iterable[Any], threads: int = 4) -> list[Any]:
    """``work`` on each item, a few at a time: small fits leave most of a cluster idle."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, items))


def balance_rows(train: DataFrame, mode: str = "weights", label: str = "label") -> DataFrame:
    """Training rows with ``weight``: balanced weights, synthetic minority rows of weight 1, or as they are."""
    if mode == "weights":
        return balanced_weights(train, label)
    if mode not in ("none", "oversample"):
        raise ValueError(f"unknown balance mode {mode}")
    return (balancing.oversample(train, label) if mode == "oversample" else train).withColumn("weight", F.lit(1.0))


def fit(
    kind: str, train: DataFrame, classes: Sequence[str], balance: str = "weights", **params: Any
) -> Classifier:
    """Fit one classifier on ``features`` and ``label``; ``balance`` as in ``balance_rows``."""
    train = balance_rows(train, balance)
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "logistic_regression":
        options = dict(params)
        strength = options.pop("C", 1.0)
        n = train.count()
        model = LogisticRegression(
            regParam=1.0 / (strength * n), elasticNetParam=0.0, standardization=False,
            **{"maxIter": 200, **options}, **common,
        ).fit(train)
        models = (model,)
    elif kind == "random_forest":
        options = {"numTrees": 200, "maxDepth": 10, "seed": specs.SEED, **params}
        models = (RandomForestClassifier(**options, **common).fit(train),)
    elif kind == "decision_tree":
        models = (DecisionTreeClassifier(**{"maxDepth": 5, "seed": specs.SEED, **params}, **common).fit(train),)
    elif kind == "boosted_trees":
        ensemble = boosting.fit(train, len(classes), [boosted_params(params)], row_key(), weight=F.col("weight"))[0]
        width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
        models = (boosting.Boosted(ensemble, len(classes), width),)
    else:
        raise ValueError(f"unknown classifier {kind}")
    return Classifier(kind, tuple(classes), models, params)


#: Options of the boosted trees under the names that the other classifiers' options follow.
BOOSTED_NAMES = {
    "maxIter": "rounds", "maxDepth": "depth", "stepSize": "step", "subsamplingRate": "rows", "featureShare": "columns",
    "regAlpha": "alpha", "regLambda": "lambda_", "minChildWeight": "min_child_weight",
}


def boosted_params(params: Mapping[str, Any]) -> boosting.Params:
    return boosting.Params(**{BOOSTED_NAMES[k]: v for k, v in params.items()})


def row_key() -> Column:
    """What a row's draws depend on."""
    return F.concat_ws(",", F.col("label").cast("string"), F.array_join(vector_to_array("features").cast("array<string>"), ","))


def grid(kind: str, choices: Mapping[str, Sequence[Any]] | None = None) -> list[dict[str, Any]]:
    options = choices if choices is not None else GRIDS[kind]
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


Folds = Iterable[tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class SlotFolds:
    """Folds over rows with a slot: which slots train and which validate each fold. Iterating gives the frames."""

    rows: DataFrame
    slot: str
    parts: tuple[tuple[frozenset[int], frozenset[int]], ...]

    def __iter__(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        for train, held in self.parts:
            yield self.rows.where(F.col(self.slot).isin(*train)), self.rows.where(F.col(self.slot).isin(*held))

    @property
    def held_slots(self) -> list[int] | None:
        """The one slot that each fold holds out, if all others train it."""
        every = frozenset().union(*(a | b for a, b in self.parts))
        whole = all(len(held) == 1 and train == every - held for train, held in self.parts)
        return [next(iter(held)) for _, held in self.parts] if whole else None


def k_folds(rows: DataFrame, slot: str, k: int = 5) -> SlotFolds:
    """Each of the slots 0 .. k-1 held out once."""
    return SlotFolds(rows, slot, tuple((frozenset(range(k)) - {i}, frozenset([i])) for i in range(k)))


def hash_folds(df: DataFrame, fold: Column, k: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    marked = df.withColumn("_fold", fold)
    return [
        (marked.where(F.col("_fold") != i).drop("_fold"), marked.where(F.col("_fold") == i).drop("_fold"))
        for i in range(k)
    ]


def cross_validate(
    kind: str, folds: Folds, classes: Sequence[str], params: Mapping[str, Any], balance: str = "weights"
) -> float | None:
    """Mean macro F1 over the folds; folds whose training part has one class are skipped.

    Rows are balanced inside each training part, never in what it is checked on.
    """
    return _cross_validated(kind, folds, classes, [params], balance)[0]


def _cross_validated(
    kind: str, folds: Folds, classes: Sequence[str], points: Sequence[Mapping[str, Any]], balance: str
) -> list[float | None]:
    """``cross_validate`` of each point; small fits of all points and folds run a few at a time."""
    folds = list(folds)

    def one(job: tuple[Mapping[str, Any], tuple[DataFrame, DataFrame]]) -> float | None:
        params, (train, val) = job
        if train.select("label").distinct().count() < 2 or val.isEmpty():
            return None
        model = fit(kind, train, classes, balance, **params)
        return metrics.macro_f1(model.predict(val), "_class", "pred")

    if not folds:
        return [None] * len(points)
    found = in_parallel(one, product(points, folds), at_once(folds[0][0]))
    by_point = [[s for s in found[at : at + len(folds)] if s is not None] for at in range(0, len(found), len(folds))]
    return [sum(scores) / len(scores) if scores else None for scores in by_point]


def grid_scores(
    kind: str, folds: Folds, classes: Sequence[str], choices: Mapping[str, Sequence[Any]] | None = None, balance: str = "weights"
) -> list[tuple[dict[str, Any], float | None]]:
    """Mean macro F1 of every grid point.

    With slots, all folds and grid points of the logistic regression and of the boosted trees are trained in the same
    passes; other searches fit one after another.
    """
    points = grid(kind, choices)
    if isinstance(folds, SlotFolds) and balance != "oversample":
        if kind == "logistic_regression" and all(set(p) <= {"C"} for p in points):
            strengths = [float(p.get("C", 1.0)) for p in points]
            found = newton.search(folds.rows, folds.slot, folds.parts, strengths, len(classes), balance == "weights").groupBy(
                "c").agg(F.avg("f1_macro").alias("f1")).collect()
            by_strength = {r["c"]: float(r["f1"]) for r in found}
            return [(p, by_strength.get(c)) for p, c in zip(points, strengths, strict=True)]
        if kind == "boosted_trees" and folds.held_slots is not None:
            return _boosted_scores(folds, points, len(classes), balance == "weights")
    return list(zip(points, _cross_validated(kind, folds, classes, points, balance), strict=True))


#: Grid points of boosted trees on rows of one task whose trees the driver holds at a time.
POINTS_AT_ONCE = 8


def _boosted_scores(folds: SlotFolds, points: Sequence[dict[str, Any]], n_classes: int, balanced: bool) -> list[tuple[dict[str, Any], float | None]]:
    """Every grid point and fold in the same jobs; of rows that are one task, ``POINTS_AT_ONCE`` points."""
    rows = newton.slot_rows(folds.rows, folds.slot)
    held = folds.held_slots
    weights = newton.class_weights(rows, newton.fold_models([1.0], folds.parts), n_classes)
    k = len(held)
    candidates = [
        replace(boosted_params(p), held=slot, class_weights=tuple(weights[i]) if balanced else None, number=at * k + i)
        for at, p in enumerate(points) for i, slot in enumerate(held)
    ]
    step = k * (POINTS_AT_ONCE if rows.count() <= boosting.TASK_ROWS else len(points))
    found: dict[int, float] = {}
    for first in range(0, len(candidates), step):
        some = candidates[first : first + step]
        fitted = boosting.fit(folds.rows, n_classes, some, row_key(), F.col(folds.slot))
        classify = [
            (lambda x, e=e: (e.score(x)[:, 0] > 0).astype(int)) if n_classes == 2 else (lambda x, e=e: e.score(x).argmax(axis=1)) for e in fitted
        ]
        table = newton.slot_confusions(rows, [[c.held] for c in some], classify)
        found |= {first + r["model"]: float(r["f1_macro"]) for r in metrics.report(table, ["model"]).collect()}
    means = []
    for at, point in enumerate(points):
        own = [found[m] for m in range(at * k, (at + 1) * k) if m in found]
        means.append((point, sum(own) / len(own) if own else None))
    return means


def search(
    kind: str, folds: Folds, classes: Sequence[str], choices: Mapping[str, Sequence[Any]] | None = None, balance: str = "weights"
) -> tuple[dict[str, Any], float]:
    """The first grid point with the best mean macro F1."""
    best, best_score = {}, -1.0
    for params, score in grid_scores(kind, folds, classes, choices, balance):
        if score is not None and score > best_score:
            best, best_score = params, score
    return best, best_score


def train_all(
    train: DataFrame,
    test: DataFrame,
    classes: Sequence[str],
    folds: Folds,
    choices: Mapping[str, Mapping[str, Sequence[Any]]] | None = None,
    balance: str = "weights",
) -> tuple[dict[str, Classifier], DataFrame]:
    """Search and refit each classifier; returns them with one result row each."""
    fitted: dict[str, Classifier] = {}
    rows = []
    for kind in choices if choices is not None else GRIDS:
        params, cv_f1 = search(kind, folds, classes, None if choices is None else choices[kind], balance)
        fitted[kind] = fit(kind, train, classes, balance, **params)
        row = metrics.evaluate(fitted[kind].predict(test), (), "_class", "pred").collect()[0]
        rows.append((
            kind, str(params), float(cv_f1), float(row["f1_macro"]), float(row["accuracy"]),
            float(row["balanced_accuracy"]), float(row["recall_macro"]), float(cv_f1 - row["f1_macro"]),
        ))
    schema = (
        "model string, params string, cv_f1 double, test_f1 double, accuracy double, "
        "balanced_accuracy double, macro_recall double, cv_test_gap double"
    )
    return fitted, train.sparkSession.createDataFrame(rows, schema)


def champion(results: DataFrame) -> str:
    """Model with the best test macro F1."""
    return results.agg(F.max_by("model", "test_f1")).collect()[0][0]


def cluster(df: DataFrame, ks: Sequence[int] = tuple(range(2, 9))) -> tuple[Any, DataFrame]:
    """k-means for the k of best silhouette, refitted on all rows; returns (model, k table)."""
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")

    def one(k: int) -> tuple[int, float, float]:
        model = KMeans(k=k, seed=specs.SEED, featuresCol="features", predictionCol="cluster").fit(df)
        return k, float(evaluator.evaluate(model.transform(df))), float(model.summary.trainingCost)

    rows = in_parallel(one, ks)
    best = max(rows, key=lambda r: r[1])[0]
    model = KMeans(k=best, seed=specs.SEED, featuresCol="features", predictionCol="cluster").fit(df)
    table = df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")
    return model, table.withColumn("chosen", F.col("k") == best)


def project_clusters(model: Any, fit_on: DataFrame, df: DataFrame) -> DataFrame:
    """Cluster of each row and its first two principal components."""
    pca = PCA(k=2, inputCol="features", outputCol="_pc").fit(fit_on)
    out = pca.transform(model.transform(df))
    xy = vector_to_array("_pc")
    return out.withColumns({"pc1": F.get(xy, F.lit(0)), "pc2": F.get(xy, F.lit(1))}).drop("_pc")


def out_of_fold(
    kind: str, df: DataFrame, classes: Sequence[str], fold: Column, k: int = 5, **params: Any
) -> DataFrame:
    """Each row's probabilities from the model that did not see its fold."""
    # stored at once: else the driver and every task of the union hold the models of all folds
    parts = in_parallel(lambda f: cut_lineage(fit(kind, f[0], classes, **params).predict(f[1])), hash_folds(df, fold, k), at_once(df))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


Fit = Callable[..., Classifier]
