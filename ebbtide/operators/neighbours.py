"""Exact nearest neighbours within one table, as a join over ranges of a projection.

Rows are projected onto one direction and cut into ranges of about ``RANGE_ROWS`` rows. Two rows are at least as far
apart as their projections, so all rows nearer than r lie within r on the line. Each range is first searched by itself;
the k-th distance found there is a bound, and the rows whose bound reaches over a border are sent to the ranges within
it, where they look for nearer ones. Every range is one group of bounded size, whatever the size of the table, and the
result is that of comparing all pairs.

A range of equal projections could not be cut by value, so ranges are cut by (projection, row id): the table's total order.
Ties in distance are broken by row id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.operators.ranking import dense_index
from ebbtide.session import stored

RANGE_ROWS = 2000
STEP_CELLS = 1 << 22


def projection(v: Column, width: int, seed: int = specs.SEED) -> Column:
    """Dot product with a fixed random direction of length one."""
    direction = np.random.default_rng(seed).normal(size=width)
    direction /= np.sqrt((direction**2).sum())
    weights = F.array(*[F.lit(float(d)) for d in direction])
    return F.aggregate(F.zip_with(v, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def in_ranges(rows: DataFrame, range_rows: int) -> DataFrame:
    """Add ``range``: ``range_rows`` rows each, in the order of (line, id)."""
    numbered = dense_index(rows, ["line", "id"], "neighbour-index", 8 * range_rows)
    return numbered.withColumn("range", F.floor(F.col("index") / range_rows).cast("long")).drop("index")


def _nearest(asking: np.ndarray, asking_id: np.ndarray, among: np.ndarray, among_id: np.ndarray, k: int) -> tuple[list, list]:
    """Ids and distances of the k nearest others of every asking row, nearest first."""
    ids, distances = [], []
    step = max(1, STEP_CELLS // max(len(among) * among.shape[1], 1))
    by_id = np.argsort(among_id, kind="stable")
    among, among_id = among[by_id], among_id[by_id]
    for first in range(0, len(asking), step):
        part = asking[first : first + step]
        squares = ((part[:, None, :] - among[None, :, :]) ** 2).sum(axis=2)
        squares[asking_id[first : first + step, None] == among_id[None, :]] = np.inf
        order = np.argsort(squares, axis=1, kind="stable")[:, :k]
        for own, row in zip(order, squares, strict=True):
            own = own[np.isfinite(row[own])]
            ids.append(among_id[own].tolist())
            distances.append(np.sqrt(row[own]).tolist())
    return ids, distances


PAIRS = "id long, near array<long>, distance array<double>"


def _pairs(ids: pd.Series, near: list, distances: list) -> pd.DataFrame:
    return pd.DataFrame({
        "id": ids.astype("int64").to_numpy(), "near": pd.Series(near, dtype=object), "distance": pd.Series(distances, dtype=object),
    })


def _zipped() -> Column:
    return F.zip_with("near", "distance", lambda i, d: F.struct(i.alias("id"), d.alias("distance")))


def nearest(rows: DataFrame, k: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, neighbours): the k nearest other rows of each row of (id long, v array<double>), as (id, distance), nearest first.

    Ids are unique. Fewer than k others give as many as there are.
    """
    width = len((rows.select("v").first() or [[]])[0])
    placed = stored(in_ranges(rows.select("id", "v", projection(F.col("v"), width).alias("line")), max(range_rows, k + 1)), "neighbour-ranges")
    edges = placed.groupBy("range").agg(F.min("line").alias("low"), F.max("line").alias("high"))

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(group["v"].to_list()), group["id"].to_numpy()
        return _pairs(group["id"], *_nearest(x, ids, x, ids, k))

    first = stored(placed.select("range", "id", "v").groupBy("range").applyInPandas(alone, PAIRS).select("id", _zipped().alias("near")), "neighbour-first")
    # a row that has not found k in its own range may have any of the others
    reach = F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.get("near", F.lit(k - 1))["distance"] * (1 + 1e-9))
    asking = first.join(placed.select("id", "line", "v", "range"), "id").select("id", "line", "v", "near", F.col("range").alias("home"), reach.alias("reach"))
    bounds = F.broadcast(edges)  # a row per range_rows rows, three numbers each
    sent = stored(asking.join(
        bounds, (F.col("range") != F.col("home")) & (F.col("low") <= F.col("line") + F.col("reach")) & (F.col("high") >= F.col("line") - F.col("reach"))
    ).select("range", "id", "v"), "neighbour-visits")
    # a range that many rows visit is copied, so that no group holds more than about range_rows visitors
    copies = F.broadcast(sent.groupBy("range").agg(F.ceil(F.count("*") / range_rows).cast("int").alias("copies")))

    def visiting(asking: pd.DataFrame, among: pd.DataFrame) -> pd.DataFrame:
        near, distances = [], []
        if len(asking) and len(among):
            x, ids = np.stack(among["v"].to_list()), among["id"].to_numpy()
            near, distances = _nearest(np.stack(asking["v"].to_list()), asking["id"].to_numpy(), x, ids, k)
        return _pairs(asking["id"] if near else asking["id"][:0], near, distances)

    asked = sent.join(copies, "range").withColumn("share", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
    among = placed.select("range", "id", "v").join(copies, "range").withColumn("share", F.explode(F.expr("sequence(0, copies - 1)")))
    visited = asked.select("range", "share", "id", "v").groupBy("range", "share").cogroup(
        among.select("range", "share", "id", "v").groupBy("range", "share")
    ).applyInPandas(visiting, PAIRS).select("id", _zipped().alias("near"))
    merged = first.select("id", "near").union(visited).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    ordered = F.array_sort(F.transform("near", lambda n: F.struct(n["distance"].alias("distance"), n["id"].alias("id"))))
    return merged.select("id", F.slice(ordered, 1, k).alias("neighbours"))
