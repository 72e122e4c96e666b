"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import jaccard_join, mixing, packing, quality, toxicity
from ebbtide.llm.common import one_row_per_id, stored, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; every row is judged by what it holds, without an id too."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, row by row; null and empty texts stay."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five-word shingle similarity of 0.8 or more, the least id stays.

    Rows of one id are one document, of which the least row stays. Documents without an id take no part and stay.
    """
    members, _ = jaccard_join.similar_documents(docs, width=5, num=4, den=5, every=False)
    return one_row_per_id(without(docs, members.filter("component_id <> doc_id").select("doc_id")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row per pass over its source; documents without words are not taken."""
    return mixing.mixed_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of the documents; what the mix took of one document never shares a bin.

    Documents without an id are told apart by their texts.
    """
    copies = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return packing.pack(docs.select("doc_id", "source", "text", copies.alias("cluster")), cluster="cluster")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and seeded draws have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
