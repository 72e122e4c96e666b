"""Time-ordered splits and folds.

Ranks are taken over the table of distinct periods, which is bounded by the calendar; the panel
itself is only filtered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.sampling import row_hash


def periods_of(df: DataFrame, time_col: str) -> list:
    """Sorted distinct periods (a calendar-bounded list)."""
    rows = df.select(time_col).where(F.col(time_col).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def period_ranks(df: DataFrame, time_col: str) -> DataFrame:
    """(period, zero-based rank) over the distinct periods."""
    distinct = df.select(time_col).where(F.col(time_col).isNotNull()).distinct()
    return distinct.withColumn(
        "rank", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(time_col)) - 1
    )


def last_periods_split(
    df: DataFrame, time_col: str, test_periods: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the last periods held out; with too few, all but the first."""
    periods = periods_of(df, time_col)
    if len(periods) <= test_periods:
        test_periods = max(1, len(periods) - 1)
    boundary = F.lit(periods[-test_periods])
    return df.where(F.col(time_col) < boundary), df.where(F.col(time_col) >= boundary)


def fold_bounds(
    n_periods: int, min_train: int = 6, val_periods: int = 1, expanding: bool = True
) -> list[tuple[int, int, int, int]]:
    """(first train rank, end of train, first validation rank, end of validation) per fold."""
    if n_periods < min_train + val_periods:
        cut = max(1, int(n_periods * 0.8))
        return [(0, cut, cut, n_periods)] if cut < n_periods else []
    return [
        (0 if expanding else max(0, i - min_train), i, i, i + val_periods)
        for i in range(min_train, n_periods - val_periods + 1)
    ]


def walk_forward(
    df: DataFrame, time_col: str, min_train: int = 6, val_periods: int = 1, expanding: bool = True
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, validation) frames, each a period filter on the input."""
    periods = periods_of(df, time_col)
    t = F.col(time_col)
    for a, b, c, d in fold_bounds(len(periods), min_train, val_periods, expanding):
        train = df.where((t >= F.lit(periods[a])) & (t <= F.lit(periods[b - 1])))
        yield train, df.where((t >= F.lit(periods[c])) & (t <= F.lit(periods[d - 1])))


def walk_forward_slots(
    df: DataFrame, time_col: str, min_train: int = 6, val_periods: int = 1, expanding: bool = True
) -> tuple[DataFrame, list[tuple[range, range]]]:
    """(rows with ``_slot``, the rank of their period; the ranks that train and validate each fold)."""
    periods = periods_of(df, time_col)
    ranks = df.sparkSession.createDataFrame(list(enumerate(periods)), ["_slot", "_of"])  # a row per period
    rows = df.join(F.broadcast(ranks), F.col(time_col) == F.col("_of")).drop("_of")
    bounds = fold_bounds(len(periods), min_train, val_periods, expanding)
    return rows, [(range(a, b), range(c, d)) for a, b, c, d in bounds]


def fold_roles(
    ranked: DataFrame, n_periods: Column, min_train: int = 6, val_periods: int = 1
) -> DataFrame:
    """Expand (rank, ..) rows of an expanding walk-forward to (fold, role, ..).

    A period trains every later fold and validates the folds that start just before it, so the
    folds of a row follow from its rank and no join is needed. Apply it to per-period totals.
    """
    ranked = ranked.withColumn("_last", n_periods.cast("int") - val_periods)
    rank, last = F.col("rank"), F.col("_last")

    def folds(low: Column, high: Column, role: str) -> Column:
        span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(span, lambda i: F.struct(i.alias("fold"), F.lit(role).alias("role")))

    train = folds(F.greatest(rank + 1, F.lit(min_train)), last, "train")
    val = folds(
        F.greatest(rank - val_periods + 1, F.lit(min_train)), F.least(rank, last), "validation"
    )
    return ranked.withColumn("_f", F.explode(F.concat(train, val))).select(
        "_f.fold", "_f.role", *[c for c in ranked.columns if c != "_last"]
    )


def per_product_split(
    df: DataFrame, id_col: str, time_col: str, test_frac: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """The last rows of each product are the test rows; single-row products only train."""
    order = Window.partitionBy(id_col).orderBy(time_col)
    n = F.count("*").over(Window.partitionBy(id_col))
    held = F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), F.bround(n * test_frac).cast("int")))
    marked = df.withColumn("_test", F.row_number().over(order) > n - held)
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


STRATUM_BUCKETS = 4096


def class_ranks(df: DataFrame, label: str, keys: Sequence[str], salt: str) -> DataFrame:
    """Add ``_rank`` (1 .. n of the row's class in hash order, ties by the keys) and ``_n``.

    Rows are ranked inside hash buckets, buckets by their totals, so no class is ordered in one task.
    """
    width = 2**32 // STRATUM_BUCKETS
    placed = df.withColumn("_h", row_hash(keys, salt)).withColumn("_bucket", F.floor(F.col("_h") / width))
    totals = placed.groupBy(F.col(label).alias("_of"), F.col("_bucket").alias("_in")).agg(F.count("*").alias("_m"))
    whole = Window.partitionBy("_of")
    before = whole.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_of", "_in", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_n")
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_h", *keys)
    ranked = placed.withColumn("_place", F.row_number().over(inside))
    joined = ranked.join(offsets, F.col(label).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_place")).alias("_rank"), "_n")


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], frac: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """(rest, held out): of every class the first ``frac`` of its rows, rounded half up, in hash order."""
    ranked = class_ranks(df, label, keys, "split")
    marked = ranked.withColumn("_held", F.col("_rank") <= F.floor(F.col("_n") * frac + 0.5)).drop("_rank", "_n")
    return marked.where(~F.col("_held")).drop("_held"), marked.where("_held").drop("_held")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Add ``_fold``: rows of a class are dealt to the folds in turn, in hash order."""
    ranked = class_ranks(df, label, keys, "fold")
    return ranked.withColumn("_fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def fold_column(keys: Sequence[str], k: int = 5) -> Column:
    """Fold number of a row from the hash of its key."""
    return (row_hash(keys, "fold") % k).cast("int")


def seen_labels(test: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Test rows whose class occurs in the training rows."""
    known = train.select(label).where(F.col(label).isNotNull()).distinct()
    return test.join(known, label, "left_semi")


def needs_fallback(train: DataFrame, label: str, minimum: int = 10) -> bool:
    """Whether the training part has fewer than two classes or too small a class."""
    counts = [r["count"] for r in train.groupBy(label).count().collect()]
    return len(counts) < 2 or min(counts) < minimum
