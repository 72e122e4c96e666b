"""Running totals and row numbers over a whole table, without a single-task window.

Rows are range-partitioned, so that partitions are numbered in order and their number follows the rows. Totals are
accumulated over the table of partitions, a row each, and inside every partition over its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import stored

#: Rows of a partition, about.
PART_ROWS = 200_000


def range_parts(rows: DataFrame, order: Sequence[str], name: str, part_rows: int | None = None) -> DataFrame:
    """``rows`` stored with ``_part``, the number of their range in the given order."""
    rows = stored(rows, name)
    parts = max(1, -(-rows.count() // (part_rows or PART_ROWS)))
    return stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def _before(keys: Sequence[str]) -> tuple:
    whole = Window.partitionBy(*keys)  # one row per range
    return whole, whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    values: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], part_rows: int | None = None
) -> DataFrame:
    """Add ``{w}_below`` (sum over smaller values) and ``{w}_total`` per weight.

    ``values`` holds one row per key and value; the keys must have few combinations (classes).
    """
    parted = range_parts(values, [*keys, value], "ranked", part_rows)
    totals = parted.groupBy(*keys, "_part").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    whole, before = _before(keys)
    offsets = totals.select(
        *keys, "_part",
        *[F.coalesce(F.sum(f"_{w}").over(before), F.lit(0)).alias(f"_{w}_before") for w in weights],
        *[F.sum(f"_{w}").over(whole).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(F.broadcast(offsets), [*keys, "_part"])  # a row per range and key
    return joined.select(
        *values.columns,
        *[
            (F.col(f"_{w}_before") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_below")
            for w in weights
        ],
        *[f"{w}_total" for w in weights],
    )


def dense_index(rows: DataFrame, order: Sequence[str], name: str = "index", part_rows: int | None = None) -> DataFrame:
    """Add ``index``, 0 .. n-1 in the given order."""
    parted = range_parts(rows, order, name, part_rows)
    _, before = _before([])
    offsets = parted.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parted.withColumn("_place", place).join(F.broadcast(offsets), "_part")  # a row per range
    return numbered.withColumn("index", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_part", "_place", "_before")


def permuted(index: Column, n: int, key: int, rounds: int = 24) -> Column:
    """A keyed bijection of 0 .. n-1: in every round a place and its mirror image are swapped or not, by a hash of the two."""
    turns = [int(k) for k in np.random.default_rng(key).integers(0, n, rounds)]

    def swapped(x: Column, turn: Column) -> Column:
        mirror = F.pmod(turn - x, F.lit(n))
        swaps = F.xxhash64(F.lit(key), turn, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swaps, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(t).cast("long") for t in turns]), index.cast("long"), swapped)
