"""Writing panels, feature layers, summaries, samples, metrics and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S
from ebbtide.operators.sampling import capped_sample, hash_sample
from ebbtide.sources.readers import PANEL_SUFFIX, path_exists

SAMPLE_ROWS = 100_000


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; text keeps its surrounding blanks and embedded quotes."""
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_panel(panel: DataFrame, folder: str, source: str) -> str:
    """A processed panel where panel discovery finds it, periods as ``yyyy-MM`` text."""
    text = panel.withColumn("month", S.period_text(F.col("month")))
    return write_csv(text, f"{folder.rstrip('/')}/{source}{PANEL_SUFFIX}.csv")


def write_features(df: DataFrame, base: str, partition: str = "month") -> str:
    """A Parquet feature layer partitioned by period; a large period is split over several tasks and files."""
    path = f"{base}.parquet"
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").partitionBy(partition).parquet(path)
    return path


def write_summary(df: DataFrame, path: str) -> str:
    """A small summary table as one CSV file."""
    return write_csv(df.coalesce(1), path)


def write_metrics(df: DataFrame, path: str) -> str:
    """Metric rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def export_event_sample(events: DataFrame, keys: Sequence[str], path: str, n: int = SAMPLE_ROWS) -> str:
    return write_csv(capped_sample(events, keys, n), path)


def export_fraction(events: DataFrame, key: str, path: str, fraction: float = 0.10) -> str:
    return write_csv(hash_sample(events, key, fraction), path)


def cached_embeddings(
    spark: SparkSession, path: str, make: DataFrame, key: str = "vec_id"
) -> DataFrame:
    """The stored embedding table, written from ``make`` on first use."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(key, "embedding")
