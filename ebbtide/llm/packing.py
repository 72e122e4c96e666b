"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents longer than a bin are cut into pieces of a whole bin and a rest. Pieces are dealt to shards by hash
(whatever their source or cluster, so that no source or group of copies gathers in one shard) and every shard
is packed by itself, largest pieces first. Open bins are ordered by residual. A piece looks up the tightest bin
that it fits in and goes on to the successor until it finds one that it is compatible with: the bin's bitmap
of duplicate clusters must not hold its cluster, and the bin's topmost source bitmap not its source (one bitmap
per count up to ``per_source``). If no open bin is compatible, a new one is opened.

Defined results: documents without words (null or empty texts) take no place and give no row; a null source or
cluster is a value of its own; repeated rows are packed each and share a cluster, so they never share a bin;
ties go to the lower document id; other columns are not read; an empty table gives an empty result. Very long
texts become many pieces; pieces of one document never share a bin, as they share its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import count_words, lower_ascii, stored, text_of

CAPACITY = 2048
PER_SOURCE = 4
SHARD_PIECES = 4096
SCHEMA = "doc_id long, source string, cluster long, piece int, first_word long, n_words long, shard long, bin int, bin_words long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """Bin of each piece; pieces come largest first.

    ``sources`` and ``clusters`` are bits to set in the bitmaps (whole numbers), 0 where no conflict is possible.
    Open bins are (residual, bin) in ascending order.
    """
    open_bins: list[tuple[int, int]] = []
    cluster_bits: list[int] = []
    source_bits: list[list[int]] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            chosen = open_bins[at][1]
            if not (cluster_bits[chosen] & cluster or source_bits[chosen][-1] & source):
                residual = open_bins.pop(at)[0]
                break
            at += 1
        else:
            chosen, residual = len(cluster_bits), capacity
            cluster_bits.append(0)
            source_bits.append([0] * per_source)
        cluster_bits[chosen] |= cluster
        levels = source_bits[chosen]
        for k in range(per_source):
            if not levels[k] & source:
                levels[k] |= source
                break
        if residual > size:
            insort(open_bins, (residual - size, chosen))
        placed.append(chosen)
    return placed


def _bits(values: pd.Series, repeated_only: bool) -> list[int]:
    """A bit for each value; none for a value that occurs once if only repeated ones can conflict."""
    codes, counts = np.unique(pd.factorize(values, use_na_sentinel=False)[0], return_inverse=True, return_counts=True)[1:]
    number = np.cumsum(counts > 1) - 1 if repeated_only else np.arange(len(counts))
    return [0 if repeated_only and counts[c] == 1 else 1 << int(number[c]) for c in codes]


def pack_shard(capacity: int, per_source: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], na_position="last"
        )
        bins = best_fit(
            rows["n_words"].tolist(), _bits(rows["source"], False), _bits(rows["cluster"], True), capacity, per_source
        )
        rows = rows.assign(bin=np.array(bins, dtype="int32"))
        return rows.assign(bin_words=rows.groupby("bin")["n_words"].transform("sum"))

    return pack


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES,
    cluster: str | None = None,
) -> DataFrame:
    """Rows doc_id, source, cluster, piece, first_word, n_words, shard, bin, bin_words (words in the bin).

    ``cluster`` names a column of duplicate clusters (long); without it, texts that are equal but for ASCII case
    are copies. A bin is (shard, bin).
    """
    copies = F.col(cluster).cast("long") if cluster else F.xxhash64(lower_ascii(F.col("text")))
    sized = stored(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), copies.alias("cluster"),
                    count_words(text_of(F.col("text"))).alias("n")).filter("n > 0"),
        "packing-sizes",
    )
    n_pieces = sized.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, -(-int(n_pieces) // shard_pieces))
    pieces = sized.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "cluster", "n",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)).alias("piece"),
    ).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("first_word"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(shards)).cast("long").alias("shard"),
    )
    return pieces.groupBy("shard").applyInPandas(pack_shard(capacity, per_source), SCHEMA)
