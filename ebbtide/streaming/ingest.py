"""Chunked ingest of event files as a bounded stream.

Files arrive in micro-batches of limited size, each is filtered, sampled and appended to a Parquet
log; the checkpoint in the shared folder makes a restarted ingest continue where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ebbtide.functions import scalars as S
from ebbtide.operators import cleaning
from ebbtide.operators.sampling import hash_sample


def read_event_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100
) -> DataFrame:
    """CSV event files as a stream, a limited number of files at a time."""
    return (
        spark.readStream.schema(schema).option("header", True)
        .option("maxFilesPerTrigger", files_per_batch).csv(path)
    )


def ingest(
    events: DataFrame, target: str, checkpoint: str, key: str | None = None, fraction: float = 1.0
) -> StreamingQuery:
    """Append valid (and optionally sampled) events to ``target`` until the input is exhausted."""
    rows = cleaning.valid_events(events)
    if key is not None and fraction < 1.0:
        rows = hash_sample(rows, key, fraction)
    return (
        rows.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def rolling_engagement(events: DataFrame, lateness: str = "1 day", width: str = "7 days") -> DataFrame:
    """Per product and time window: the engagement sums of the usage panel, for late-bounded input."""
    scored = events.withColumn("engagement_score", S.event_weight(F.col("event_type")))
    return (
        scored.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", width), "product_id")
        .agg(
            F.sum("engagement_score").alias("engagement_total"),
            F.count("engagement_score").alias("event_count"),
            F.count_if(F.col("event_type") == "view").alias("view_count"),
            F.count_if(F.col("event_type") == "cart").alias("cart_count"),
            F.count_if(F.col("event_type") == "purchase").alias("purchase_count"),
            F.avg("price").alias("avg_price"),
        )
    )
