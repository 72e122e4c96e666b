"""Review-text features per product and period: statistics and precomputed embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions import text as X
from ebbtide.session import stored

MEAN_COMPONENTS = 32
MAX_STD_COMPONENTS = 8
MAX_GROUPS = 4_096  # groups whose moments a task holds before it passes them on


def document_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every text, once per document."""
    split = documents.select(key, text, X.words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    stats = X.text_statistics(F.col(text), F.col("_words"))
    return split.select(key, *[c.alias(name) for name, c in stats.items()])


def text_features(
    reviews: DataFrame, statistics: DataFrame, key: str, group: Sequence[str]
) -> DataFrame:
    """Mean and deviation of the text statistics per group; a single review has deviation 0.

    Statistics are joined per document, so review rows carry seven numbers instead of the text.
    """
    names = [c for c in statistics.columns if c != key]
    rows = reviews.select(*group, key).join(statistics, key)
    aggs = []
    for c in names:
        aggs.append(F.avg(c).alias(f"nlp_{c}_mean"))
        aggs.append(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"nlp_{c}_std"))
    return rows.groupBy(*group).agg(*aggs)


def embedding_features(rows: DataFrame, group: Sequence[str], col: str = "embedding") -> DataFrame:
    """Per group: mean and sample-deviation vectors and the number of reviews.

    Tasks reduce their Arrow batches to moments per group, so vectors are neither sorted nor shuffled by group; a
    missing vector or number counts as a review only.
    """
    keys = rows.select(*group).schema
    values = rows.select(*group, F.transform(col, lambda x: x.cast("double")).alias("_v"))
    partial = T.StructType([
        *keys.fields, T.StructField("_rows", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_n", "_mean", "_m2")],
    ])
    merged = T.StructType([
        *keys.fields, T.StructField("embedding_mean", T.ArrayType(T.DoubleType())),
        T.StructField("embedding_std", T.ArrayType(T.DoubleType())), T.StructField("n_reviews", T.LongType()),
    ])
    moments = values.mapInArrow(_group_moments(len(group)), partial)
    out = moments.groupBy(*group).applyInArrow(_merged_moments(len(group)), merged)
    return out.select(
        *group, array_to_vector("embedding_mean").alias("embedding_mean"), array_to_vector("embedding_std").alias("embedding_std"), "n_reviews",
    )


def _padded(vectors: pa.ListArray) -> np.ndarray:
    """Rows of numbers; NaN where a vector is missing, has no number or is shorter than the longest."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = np.full((len(vectors), lengths.max(initial=0)), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _codes(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct key and the key's number by row."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def _combine(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Counts, means and squared deviations of two disjoint sets together."""
    n = a[0] + b[0]
    change = b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    return [n, a[1] + change * share, a[2] + b[2] + change * change * a[0] * share]


def _batch_moments(x: np.ndarray, code: np.ndarray, n_groups: int) -> list[np.ndarray]:
    order = np.argsort(code, kind="stable")
    x, starts = x[order], np.searchsorted(code[order], np.arange(n_groups))
    seen = ~np.isnan(x)
    n = np.add.reduceat(seen.astype(float), starts)
    mean = np.add.reduceat(np.where(seen, x, 0.0), starts) / np.maximum(n, 1)
    return [n, mean, np.add.reduceat(np.where(seen, x - mean[code[order]], 0.0) ** 2, starts)]


def _group_moments(n_keys: int):
    """Rows to (key, rows, counts, means, squared deviations), a few thousand groups at a time."""

    def emit(place, names, rows, state):
        columns = [pa.array(c, t) for c, t in zip(zip(*place, strict=True), names.values(), strict=True)] if n_keys else []
        lists = [pa.array(list(x), pa.list_(pa.float64())) for x in state]
        return pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.int64()), *lists], names=[*names, "_rows", "_n", "_mean", "_m2"])

    def run(batches):
        place, names = {}, {}
        rows, state = np.zeros(0, dtype=np.int64), [np.zeros((0, 0))] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            names = dict(zip(batch.schema.names[:n_keys], batch.schema.types[:n_keys], strict=True))
            first, code = _codes(batch.columns[:n_keys])
            x = _padded(batch.column(n_keys))
            keys = zip(*[c.take(pa.array(first)).to_pylist() for c in batch.columns[:n_keys]], strict=True)
            at = np.array([place.setdefault(k, len(place)) for k in keys])
            width = max(x.shape[1], state[0].shape[1])
            grow = ((0, len(place) - len(rows)), (0, width - state[0].shape[1]))
            state = [np.pad(s, grow) for s in state]
            rows = np.pad(rows, grow[0])
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan)
            rows[at] += np.bincount(code, minlength=len(first))
            for s, new in zip(state, _combine([s[at] for s in state], _batch_moments(x, code, len(first))), strict=True):
                s[at] = new
            if len(place) > MAX_GROUPS:
                yield emit(place, names, rows, state)
                place, rows, state = {}, rows[:0], [np.zeros((0, 0))] * 3
        if place:
            yield emit(place, names, rows, state)

    return run


def _merged_moments(n_keys: int):
    """All moments of one group: a few per task, however many rows the group has."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_padded(table.column(c).combine_chunks()) for c in ("_n", "_mean", "_m2")]
        total = [np.zeros(parts[0].shape[1])] * 3
        for row in zip(*[np.nan_to_num(p) for p in parts], strict=True):
            total = _combine(total, row)
        n, mean, m2 = total
        std = np.sqrt(m2 / np.maximum(n - 1, 1))
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (mean, std)]
        keys = [table.column(i).slice(0, 1).combine_chunks() for i in range(n_keys)]
        return pa.Table.from_arrays(
            [*keys, *lists, pa.array([pc.sum(table.column("_rows")).as_py()], pa.int64())],
            names=[*table.column_names[:n_keys], "embedding_mean", "embedding_std", "n_reviews"],
        )

    return run


def reduce_embeddings(
    features: DataFrame, n_components: int = MEAN_COMPONENTS
) -> tuple[DataFrame, dict[str, list[float]]]:
    """Principal components of the mean and deviation vectors with their explained variance.

    The features are stored once: the fits and the result read them.
    """
    features = stored(features, "embedding-features")
    width = len(features.first()["embedding_mean"])
    if not n_components or n_components >= width:
        return features, {}
    explained: dict[str, list[float]] = {}
    n_std = min(n_components // 2, MAX_STD_COMPONENTS)
    out = features
    for col, k, prefix in (
        ("embedding_mean", n_components, "sbert_mean_pc"), ("embedding_std", n_std, "sbert_std_pc"),
    ):
        model = PCA(k=k, inputCol=col, outputCol="_pc").fit(features)
        values = vector_to_array("_pc")
        keep = [c for c in out.columns if c != "_pc"]
        out = model.transform(out).select(*keep, *[
            F.get(values, F.lit(i)).alias(f"{prefix}{i}") for i in range(k)
        ])
        explained[col] = [float(x) for x in model.explainedVariance]
    return out.drop("embedding_mean", "embedding_std"), explained


def enrich(panel: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Panel rows with their text features; 0 where a period has no text."""
    added = [c for c in features.columns if c not in keys]
    return panel.join(features, list(keys), "left").fillna(0, subset=added)
