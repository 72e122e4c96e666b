"""Deterministic sampling by hash of a row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S

HASH_RANGE = 2**32


def row_hash(keys: Sequence[str], salt: str = "") -> Column:
    """32-bit hash of the joined key columns."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return S.hash_bucket(F.concat(text, F.lit(salt)) if salt else text, HASH_RANGE)


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key hashes into the first ``fraction`` of a thousand buckets."""
    return df.where(S.hash_bucket(F.col(key), 1000) < int(round(fraction * 1000)))


def capped_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in hash order (top-k per partition, then merged)."""
    return (
        df.withColumn("_h", row_hash(keys)).orderBy("_h", *keys).limit(n).drop("_h")
    )
