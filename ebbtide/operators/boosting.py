"""Second-order gradient boosting: gradient and Hessian histograms as one aggregate per tree level.

Features are binned once at quantiles of the training rows. A level of a tree is one job over the rows: every task walks
its rows down the tree so far, sums gradients and Hessians per (node, feature, bin), the sums of all tasks are
added by tree, and the best split of each node is found where they meet; only splits reach the driver. A child's
sums come with its parent's split, so a tree of depth d takes d jobs, whatever the number of classes and of candidate
models: all of them grow in the same jobs. Rows that fill one task only take one job: a task per candidate grows all of its
trees, from the same sums. Of larger tables, the rows' margins are stored in the shared folder every ``STORE_EVERY`` rounds, so a
task never walks more than the trees since.

Gain, leaf weights and their penalties: with G and H the sums of a node, T(G) = sign(G) max(|G| - alpha, 0), a split gains
half of T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda), both sides need a Hessian of ``min_child_weight``, and a
leaf's weight is -T(G) / (H + lambda) times the step size. A tree sees a share of the columns and of the rows, both drawn by
hashes of their keys, so a repeated task draws the same. Two classes have one tree a round, more have one each (softmax,
Hessian 2 p (1 - p)).

Equal gains: the first feature, then the lowest bin. A node without a gain above 0 is a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators.trees import Ensemble, scored
from ebbtide.session import stored

BINS = 64
STORE_EVERY = 25
HISTOGRAM_ROWS = 1 << 15
#: Rows of a task, at least: small tables are one task.
TASK_ROWS = 1 << 16


@dataclass(frozen=True)
class Params:
    """Of one candidate; ``held`` is the fold that does not train it (None: all rows do).

    Its draws depend on ``number``, its place among the candidates if None.
    """

    rounds: int = 200
    depth: int = 4
    step: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    alpha: float = 0.0
    lambda_: float = 1.0
    min_child_weight: float = 3.0
    held: int | None = None
    class_weights: tuple[float, ...] | None = None
    number: int | None = None


@dataclass
class Tree:
    """A tree as it grows; node 0 is the root, rows of bins up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.right, self.value))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_rows(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by their keys."""
    return mixed(key.astype(np.uint64) ^ mixed(np.uint64([seed]))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


def drawn_columns(width: int, seed: int, share: float) -> np.ndarray:
    order = np.argsort(mixed(np.arange(1, width + 1, dtype=np.uint64) ^ mixed(np.uint64([seed]))), kind="stable")
    chosen = np.zeros(width, dtype=bool)
    chosen[order[: max(1, round(share * width))]] = True
    return chosen


def tree_seed(seed: int, candidate: int, round_: int, output: int) -> int:
    return (seed * 1_000_003 + candidate * 100_003 + round_ * 101 + output) & 0xFFFFFFFF


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_splits(g: np.ndarray, h: np.ndarray, columns: np.ndarray, p: Params) -> list[tuple]:
    """Per node (gain, feature, bin, GL, HL, GR, HR); ``g`` and ``h`` are nodes x features x bins."""
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h

    def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return soft(a, p.alpha) ** 2 / (b + p.lambda_)

    gain = 0.5 * (half(left_g, left_h) + half(right_g, right_h) - half(all_g, all_h))
    fine = (left_h >= p.min_child_weight) & (right_h >= p.min_child_weight) & columns[None, :, None]
    gain = np.where(fine, np.round(gain, 10), -1.0)  # sums of tasks differ in their last digits
    out = []
    for node, flat in enumerate(gain.reshape(len(gain), -1).argmax(axis=1)):
        f, b = divmod(int(flat), g.shape[2])
        out.append((
            float(gain[node, f, b]), f, b, float(left_g[node, f, b]), float(left_h[node, f, b]),
            float(right_g[node, f, b]), float(right_h[node, f, b]),
        ))
    return out


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss; ``margin`` is rows x outputs."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin))
        return p - (label == 1)[:, None], np.maximum(p * (1 - p), 1e-16)
    shifted = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = shifted / shifted.sum(axis=1, keepdims=True)
    return p - (label[:, None] == np.arange(margin.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def walked(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node of each row."""
    feature, bin_, left, right, _ = tree
    node = np.zeros(len(bins), dtype=np.int64)
    while True:
        inner = np.flatnonzero(feature[node] >= 0)
        if not len(inner):
            return node
        at = node[inner]
        node[inner] = np.where(bins[inner, feature[at]] <= bin_[at], left[at], right[at])


def cut_points(train: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 ascending cuts per feature, at quantiles of its values."""
    values = train.select(vector_to_array("features").alias("v"))
    shares = [k / bins for k in range(1, bins)]
    row = values.agg(*[F.percentile_approx(F.get("v", F.lit(k)), shares, 10_000).alias(f"c{k}") for k in range(width)]).first()
    return [np.unique(np.array(row[f"c{k}"] or [], dtype=float)) for k in range(width)]


def binned(features: pa.Array, cuts: Sequence[np.ndarray]) -> np.ndarray:
    x = np.asarray(features.flatten(), dtype=float).reshape(len(features), len(cuts))
    return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)


@dataclass
class _Rows:
    """Decoded rows of a batch: bins, labels, weights, folds, keys and margins (rows x candidates x outputs)."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    margin: np.ndarray


def _decoded(batch: pa.RecordBatch, width: int, shape: tuple[int, int]) -> _Rows:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(n, width)
    if batch.num_columns == 5:  # before the first round
        return _Rows(bins, *(batch.column(k).to_numpy() for k in range(1, 5)), np.zeros((n, *shape)))
    margin = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.float64).reshape(n, *shape)
    return _Rows(bins, *(batch.column(k).to_numpy() for k in range(1, 5)), margin)


STATE = "bins binary, label int, weight double, fold int, key long, margin binary"


def fit(
    train: DataFrame, n_classes: int, candidates: Sequence[Params], key: Column, fold: Column | None = None,
    weight: Column | None = None, bins: int = BINS, seed: int = specs.SEED, cuts: list[np.ndarray] | None = None,
) -> list[Ensemble]:
    """One ensemble of margins per candidate, all grown in the same jobs.

    ``train`` has ``features`` and ``label``; ``key`` is a row's key, for the draws. For two classes the margin is that of
    class 1.
    """
    candidates = [p if p.number is not None else replace(p, number=c) for c, p in enumerate(candidates)]
    outputs = 1 if n_classes == 2 else n_classes
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    cuts = cut_points(train, width, bins) if cuts is None else cuts
    n_bins = max(len(c) for c in cuts) + 1
    shape = (len(candidates), outputs)
    empty = np.zeros(shape).tobytes()

    def start(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = binned(batch.column(0), cuts)
            n = len(rows)
            yield pa.record_batch([
                pa.array([r.tobytes() for r in rows], pa.binary()), *(batch.column(k) for k in range(1, 5)),
                pa.array([empty] * n, pa.binary()),
            ], names=[c.split()[0] for c in STATE.split(", ")])

    parts = -(-train.count() // TASK_ROWS) or 1
    state = stored(train.repartition(parts).select(
        vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        (F.lit(-1) if fold is None else fold.cast("int")).alias("fold"), F.xxhash64(key).alias("key"),
    ).mapInArrow(start, STATE), "boosting")
    if parts == 1:
        return [_ensemble(per_output, cuts) for per_output in _grown_by_candidate(state.drop("margin"), candidates, width, n_bins, outputs, seed)]
    grown: list[list[list[Tree]]] = [[[] for _ in range(outputs)] for _ in candidates]
    last = max(p.rounds for p in candidates)
    for first in range(0, last, STORE_EVERY):
        rounds = range(first, min(first + STORE_EVERY, last))
        if first:
            state = _with_margins(state, pending, width, shape)
        pending: list[list[list[Tree]]] = [[[] for _ in range(outputs)] for _ in candidates]
        for round_ in rounds:
            trees = _round(candidates, outputs, round_, lambda trees, open_, round_=round_: _level(
                state, candidates, pending, trees, open_, width, n_bins, shape, seed, round_))
            for (c, k), tree in trees.items():
                grown[c][k].append(tree)
                pending[c][k].append(tree)
    return [_ensemble(per_output, cuts) for per_output in grown]


def _grow(tree: Tree, nodes: list[int], splits: dict[int, tuple], p: Params) -> list[int]:
    """Splits the nodes that gain; returns their children."""
    children = []
    for node in nodes:
        gain, feature, bin_, left_g, left_h, right_g, right_h = splits.get(node, (0.0, 0, 0, 0.0, 0.0, 0.0, 0.0))
        if node == 0 and node in splits:
            tree.value[0] = float(-soft(np.float64(left_g + right_g), p.alpha) / (left_h + right_h + p.lambda_) * p.step)
        if gain <= 0:
            continue
        tree.feature[node], tree.bin[node], tree.gain[node] = feature, bin_, gain
        for side, g, h in ((tree.left, left_g, left_h), (tree.right, right_g, right_h)):
            side[node] = len(tree.feature)
            children.append(len(tree.feature))
            tree.feature.append(-1)
            tree.bin.append(0)
            tree.left.append(0)
            tree.right.append(0)
            tree.gain.append(0.0)
            tree.value.append(float(-soft(np.float64(g), p.alpha) / (h + p.lambda_) * p.step))
    return children


def _margins(rows: _Rows, pending: list[list[list[tuple]]]) -> np.ndarray:
    margin = rows.margin.copy()
    for c, per_output in enumerate(pending):
        for k, trees in enumerate(per_output):
            for tree in trees:
                margin[:, c, k] += tree[4][walked(tree, rows.bins)]
    return margin


def _arrays(pending: list[list[list[Tree]]]) -> list[list[list[tuple]]]:
    return [[[t.arrays() for t in trees] for trees in per_output] for per_output in pending]


def _with_margins(state: DataFrame, pending: list[list[list[Tree]]], width: int, shape: tuple[int, int]) -> DataFrame:
    trees = _arrays(pending)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            margin = _margins(_decoded(batch, width, shape), trees)
            yield batch.set_column(5, "margin", pa.array([m.tobytes() for m in margin], pa.binary()))

    return stored(state.mapInArrow(run, STATE), "boosting")


Open = dict[tuple[int, int], list[int]]
Splits = dict[tuple[int, int], dict[int, tuple]]


def _round(candidates: Sequence[Params], outputs: int, round_: int, level: Callable[[dict, Open], Splits]) -> dict[tuple[int, int], Tree]:
    """The trees of a round, by (candidate, output); ``level`` finds the best splits of the open nodes."""
    live = [c for c, p in enumerate(candidates) if round_ < p.rounds]
    trees = {(c, k): Tree() for c in live for k in range(outputs)}
    open_ = {ck: [0] for ck in trees}
    for depth in range(max(candidates[c].depth for c in live)):
        open_ = {ck: nodes for ck, nodes in open_.items() if nodes and depth < candidates[ck[0]].depth}
        if not open_:
            break
        splits = level(trees, open_)
        open_ = {ck: _grow(trees[ck], open_[ck], splits.get(ck, {}), candidates[ck[0]]) for ck in open_}
    return trees


def _no_sums(open_: Open, cells: int) -> dict[tuple[int, int], np.ndarray]:
    return {ck: np.zeros((2, len(nodes) * cells)) for ck, nodes in open_.items()}


def _add_sums(
    total: dict[tuple[int, int], np.ndarray], rows: _Rows, margin: np.ndarray, candidates: Sequence[Params],
    partial: dict[tuple[int, int], tuple], open_: Open, n_bins: int, seed: int, round_: int,
) -> None:
    """Add the rows' gradients and Hessians per (node, feature, bin)."""
    width = rows.bins.shape[1]
    cell, cells = np.arange(width) * n_bins + rows.bins, width * n_bins
    for c in {c for c, _ in open_}:
        p = candidates[c]
        trains = np.ones(len(rows.label), dtype=bool) if p.held is None else rows.fold != p.held
        g, h = gradients(margin[:, c], rows.label)
        weight = rows.weight if p.class_weights is None else rows.weight * np.array(p.class_weights)[rows.label]
        for k in range(margin.shape[2]):
            if (c, k) not in open_:
                continue
            place = np.full(len(partial[c, k][0]), -1)
            place[open_[c, k]] = np.arange(len(open_[c, k]))
            at = place[walked(partial[c, k], rows.bins)]
            use = np.flatnonzero(trains & (at >= 0) & drawn_rows(rows.key, tree_seed(seed, p.number, round_, k), p.rows))
            flat = (at[use, None] * cells + cell[use]).ravel()
            for own, x in zip(total[c, k], (g[:, k], h[:, k]), strict=True):
                own += np.bincount(flat, weights=np.repeat((x * weight)[use], width), minlength=len(own))


def _best(
    total: dict[tuple[int, int], np.ndarray], candidates: Sequence[Params], open_: Open, width: int, n_bins: int, seed: int, round_: int,
) -> list[tuple]:
    """(candidate, output, node, *split) of the best splits."""
    out = []
    for (c, k), x in sorted(total.items()):
        g, h = x.reshape(2, -1, width, n_bins)
        columns = drawn_columns(width, tree_seed(seed, candidates[c].number, round_, k), candidates[c].columns)
        out += [(c, k, node, *s) for node, s in zip(open_[c, k], best_splits(g, h, columns, candidates[c]), strict=True)]
    return out


def _by_node(found: Iterable[tuple]) -> Splits:
    splits: Splits = {}
    for c, k, node, *split in found:
        splits.setdefault((c, k), {})[node] = tuple(split)
    return splits


def _pieces(batches: Iterable[pa.RecordBatch], width: int, shape: tuple[int, int]) -> Iterator[_Rows]:
    for batch in batches:
        for first in range(0, batch.num_rows, HISTOGRAM_ROWS):
            yield _decoded(batch.slice(first, HISTOGRAM_ROWS), width, shape)


def _grown_by_candidate(
    state: DataFrame, candidates: Sequence[Params], width: int, n_bins: int, outputs: int, seed: int,
) -> list[list[list[Tree]]]:
    """All trees by candidate and output, of rows that are one task (``TASK_ROWS`` at most): a task per candidate, in one job."""
    names = ["feature", "bin", "left", "right", "value", "gain"]
    kinds = [pa.list_(pa.int32())] * 4 + [pa.list_(pa.float64())] * 2

    def grow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[_Rows]] = {}
        for batch in it:
            place = batch.column(0).to_numpy()
            for c in np.unique(place).tolist():
                pieces = _pieces([batch.select(range(1, 6)).filter(pa.array(place == c))], width, (1, outputs))
                own.setdefault(c, []).extend(pieces)
        for c, rows in own.items():
            alone, found = [candidates[c]], []
            for round_ in range(alone[0].rounds):
                def level(trees: dict, open_: Open, round_: int = round_, rows: list[_Rows] = rows, alone: list[Params] = alone) -> Splits:
                    partial = {ck: trees[ck].arrays() for ck in open_}
                    total = _no_sums(open_, width * n_bins)
                    for piece in rows:
                        _add_sums(total, piece, piece.margin, alone, partial, open_, n_bins, seed, round_)
                    return _by_node(_best(total, alone, open_, width, n_bins, seed, round_))

                trees = _round(alone, outputs, round_, level)
                for (_, k), tree in trees.items():
                    found.append((round_, c, k, tree))
                    arrays = tree.arrays()
                    for piece in rows:
                        piece.margin[:, 0, k] += arrays[4][walked(arrays, piece.bins)]
            keys = [[f[i] for f in found] for i in range(3)]
            yield pa.record_batch(
                [pa.array(v, pa.int32()) for v in keys] + [pa.array([getattr(f[3], n) for f in found], kind) for n, kind in zip(names, kinds, strict=True)],
                names=["round", "c", "k", *names],
            )

    found_as = "round int, c int, k int, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>, gain array<double>"
    n = len(candidates)
    each = state.sparkSession.range(0, n, 1, n).withColumnRenamed("id", "_candidate")
    grown: list[list[list[Tree]]] = [[[] for _ in range(outputs)] for _ in candidates]
    # the rows go to every task: a task's worth of them, without margins
    for r in sorted(each.crossJoin(F.broadcast(state)).mapInArrow(grow, found_as).collect(), key=lambda r: r["round"]):
        grown[r["c"]][r["k"]].append(Tree(*(list(r[name]) for name in names)))
    return grown


def _level(
    state: DataFrame, candidates: Sequence[Params], pending: list[list[list[Tree]]], trees: dict[tuple[int, int], Tree],
    open_: Open, width: int, n_bins: int, shape: tuple[int, int], seed: int, round_: int,
) -> Splits:
    """Best split of every open node, by (candidate, output): one job."""
    before = _arrays(pending)
    partial = {ck: trees[ck].arrays() for ck in open_}

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _no_sums(open_, width * n_bins)
        seen = False
        for rows in _pieces(it, width, shape):
            seen = True
            _add_sums(total, rows, _margins(rows, before), candidates, partial, open_, n_bins, seed, round_)
        if seen:
            yield pa.record_batch({
                "c": pa.array([c for c, _ in total], pa.int32()), "k": pa.array([k for _, k in total], pa.int32()),
                "sums": pa.array([x.tobytes() for x in total.values()], pa.binary()),
            })

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in it:
            for c, k, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(raw, dtype=np.float64)
                total[c, k] = total[c, k] + x if (c, k) in total else x
        out = _best(total, candidates, open_, width, n_bins, seed, round_)
        names = ["c", "k", "node", "gain", "feature", "bin", "left_g", "left_h", "right_g", "right_h"]
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.int32()] + [pa.float64()] * 4
        columns_ = list(zip(*out, strict=True)) or [()] * 10
        yield pa.record_batch([pa.array(v, t) for v, t in zip(columns_, kinds, strict=True)], names=names)

    found_as = "c int, k int, node int, gain double, feature int, bin int, left_g double, left_h double, right_g double, right_h double"
    return _by_node(state.mapInArrow(sums, "c int, k int, sums binary").repartition("c", "k").mapInArrow(best, found_as).collect())


def _ensemble(per_output: list[list[Tree]], cuts: list[np.ndarray]) -> Ensemble:
    """Node tables over feature values instead of bins; a bin's upper cut is its threshold."""
    root, feature, threshold, left, right, value, gain = [], [], [], [], [], [], []
    for k, trees in enumerate(per_output):
        for tree in trees:
            at = len(feature)
            root.append(at)
            gain += tree.gain
            for f, b, lo, hi, v in zip(tree.feature, tree.bin, tree.left, tree.right, tree.value, strict=True):
                feature.append(f)
                threshold.append(float(cuts[f][b]) if f >= 0 and b < len(cuts[f]) else np.inf)
                left.append(at + lo)
                right.append(at + hi)
                value.append([v if j == k else 0.0 for j in range(len(per_output))])
    return Ensemble(
        np.array(root, dtype=np.int64), np.array(feature, dtype=np.int64), np.array(threshold), np.array(left, dtype=np.int64),
        np.array(right, dtype=np.int64), np.array(value, dtype=float).reshape(-1, len(per_output)),
        np.array(gain),
    )


def probabilities(margins: Column, n_classes: int) -> Column:
    """Class probabilities of an array of margins."""
    if n_classes == 2:
        p = 1 / (1 + F.exp(-F.get(margins, F.lit(0))))
        return F.array(1 - p, p)
    top = F.array_max(margins)
    parts = F.transform(margins, lambda m: F.exp(m - top))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


NODES = "place long, is_root boolean, feature long, threshold double, left long, right long, value array<double>, gain double"


@dataclass(frozen=True)
class Boosted:
    """A fitted classifier: its trees and what is needed to apply and store them."""

    ensemble: Ensemble
    n_classes: int
    numFeatures: int

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per node."""
        e = self.ensemble
        roots = np.zeros(len(e.feature), dtype=bool)
        roots[e.root] = True
        columns = (np.arange(len(e.feature)), roots, e.feature, e.threshold, e.left, e.right, e.value, e.gain)
        rows = list(zip(*(c.tolist() for c in columns), strict=True))
        spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, n_classes: int, n_features: int) -> Boosted:
        rows = spark.read.parquet(path).orderBy("place").toArrow()
        place, is_root, feature, threshold, left, right, _, gain = (c.to_numpy() for c in rows.columns)
        value = np.array(rows["value"].to_pylist(), dtype=float)
        return Boosted(Ensemble(place[is_root], feature, threshold, left, right, value, gain), n_classes, n_features)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Add the array of class probabilities."""
        margins = f"_margins_{out}"
        return scored(df, self.ensemble, margins).withColumn(out, probabilities(F.col(margins), self.n_classes)).drop(margins)


def with_folds(p: Params, k: int) -> list[Params]:
    """The candidate once per held fold."""
    return [replace(p, held=i) for i in range(k)]
