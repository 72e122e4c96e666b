"""Tree ensembles as node tables: margins and the contribution of every feature to every row's score.

A fitted ensemble becomes flat arrays with a row per node: feature, threshold, children and value. The value of an
inner node is what the tree would say if it stopped there, so along a row's path each split adds the change
of value from the node to the chosen child to its feature's contribution. Base value and contributions sum to
the score. The arrays are bounded by the ensemble; rows are walked in Arrow batches, all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import scratch_path

TOP = 5
#: Cells of rows x trees that are walked at once.
STEP_CELLS = 1 << 20


@dataclass(frozen=True)
class Ensemble:
    """Nodes of all trees. Rows at or below a node's threshold go left; leaves have feature -1.

    ``value`` has a column per output (class); ``root`` the first node of each tree.
    """

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray | None = None

    def importances(self, width: int) -> np.ndarray:
        """Share of all gain that each feature's splits have."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], weights=self.gain[inner], minlength=width)
        return total / max(total.sum(), 1e-300)

    @property
    def outputs(self) -> int:
        return self.value.shape[1]

    def base(self) -> np.ndarray:
        return self.value[self.root].sum(axis=0)

    def _steps(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, features, nodes, children) of each level that rows go down."""
        row = np.repeat(np.arange(len(x)), len(self.root))
        node = np.tile(self.root, len(x))
        while True:
            inner = self.feature[node] >= 0
            row, node = row[inner], node[inner]
            if not len(row):
                return
            feature = self.feature[node]
            child = np.where(x[row, feature] <= self.threshold[node], self.left[node], self.right[node])
            yield row, feature, node, child
            node = child

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """rows x features x outputs."""
        n, width = x.shape
        total = np.zeros((n * width, self.outputs))
        for row, feature, node, child in self._steps(x):
            change = self.value[child] - self.value[node]
            for k in range(self.outputs):
                total[:, k] += np.bincount(row * width + feature, weights=change[:, k], minlength=n * width)
        return total.reshape(n, width, self.outputs)

    def score(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs: the base value and all contributions."""
        total = np.tile(self.base(), (len(x), 1))
        for row, _, node, child in self._steps(x):
            change = self.value[child] - self.value[node]
            for k in range(self.outputs):
                total[:, k] += np.bincount(row, weights=change[:, k], minlength=len(x))
        return total


def slices(x: np.ndarray, ensemble: Ensemble) -> Iterator[np.ndarray]:
    rows = max(1, STEP_CELLS // max(len(ensemble.root), 1))
    for start in range(0, len(x), rows):
        yield x[start : start + rows]


def joined(parts: Sequence[Ensemble]) -> Ensemble:
    """One ensemble of the trees of several."""
    offsets = np.cumsum([0, *(len(p.feature) for p in parts)])
    return Ensemble(
        *(np.concatenate([getattr(p, name) + (at if moved else 0) for p, at in zip(parts, offsets, strict=False)])
          for name, moved in (("root", True), ("feature", False), ("threshold", False), ("left", True), ("right", True), ("value", False)))
    )


def of_forest(model: Any) -> Ensemble:
    """Node table of a Spark ML forest or tree classifier: values are class shares, averaged over the trees.

    The model's own stored form is read back, a row per node.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.save(path)
    stored = spark.read.parquet(f"{path}/data")
    many = "treeID" in stored.columns
    node = F.col("nodeData") if many else F.struct("*")
    tree = F.col("treeID") if many else F.lit(0)
    rows = stored.select(tree.alias("tree"), node.alias("n")).select(
        "tree", "n.id", "n.leftChild", "n.rightChild", "n.split.featureIndex",
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "n.impurityStats",
    ).orderBy("tree", "id").toArrow()
    tree_of, id_ = rows["tree"].to_numpy(), rows["id"].to_numpy()
    first = np.searchsorted(tree_of, np.unique(tree_of))
    offset = first[np.searchsorted(np.unique(tree_of), tree_of)]
    left, right = rows["leftChild"].to_numpy(), rows["rightChild"].to_numpy()
    leaf = left < 0
    stats = np.array(rows["impurityStats"].to_pylist())
    shares = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
    if not np.array_equal(id_, np.arange(len(id_)) - offset):
        raise ValueError("nodes are not numbered from 0 in each tree")
    return Ensemble(
        first, np.where(leaf, -1, rows["featureIndex"].to_numpy()),
        np.where(leaf, 0.0, np.nan_to_num(rows["threshold"].to_numpy(zero_copy_only=False).astype(float))),
        np.where(leaf, 0, left + offset), np.where(leaf, 0, right + offset), shares / len(first),
    )


def _matrix(values: pa.Array) -> np.ndarray:
    flat = np.asarray(values.flatten(), dtype=float)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def scored(df: DataFrame, ensemble: Ensemble, out: str = "margins", features: str = "features") -> DataFrame:
    """Add the array of the ensemble's outputs."""
    return df.withColumn(out, _score(ensemble)(vector_to_array(features)))


def _score(ensemble: Ensemble):
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = _matrix(batch)
            found = [ensemble.score(part) for part in slices(x, ensemble)]
            yield pa.array(list(np.concatenate(found)) if found else [], pa.list_(pa.float64()))

    return run


def contributions(df: DataFrame, ensemble: Ensemble, out: str = "contributions", features: str = "features") -> DataFrame:
    """Add, per output, the array of each feature's contribution."""
    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = _matrix(batch)
            found = [ensemble.contributions(part).transpose(0, 2, 1) for part in slices(x, ensemble)]
            yield pa.array([[list(c) for c in row] for part in found for row in part], pa.list_(pa.list_(pa.float64())))

    return df.withColumn(out, run(vector_to_array(features)))


def strongest(per_output: Column, names: Sequence[str], k: int = TOP) -> Column:
    """The ``k`` features of the largest mean absolute contribution over the outputs, largest first; ties by name.

    An array of (feature, value), the value being that mean, rounded to six places.
    """
    labels = F.array(*[F.lit(n) for n in names])
    outputs = F.size(per_output)
    sizes = F.aggregate(
        per_output, F.array_repeat(F.lit(0.0), len(names)),
        lambda total, one: F.zip_with(total, one, lambda a, b: a + F.abs(b)),
    )
    ranked = F.array_sort(F.zip_with(sizes, labels, lambda s, n: F.struct(
        (-F.round(s / outputs, 6)).alias("order"), n.alias("feature"), F.round(s / outputs, 6).alias("value"),
    )))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["feature"].alias("feature"), r["value"].alias("value")))
