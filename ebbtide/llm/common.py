"""Word expressions, stored intermediate tables and small helpers shared by the operators.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D. A null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import stored



def text_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words_of(col: Column) -> Column:
    """All words of a text, in order."""
    return F.array_remove(F.split(_plain(col), " "), "")


def _plain(col: Column) -> Column:
    """The text with a space for every other separator; replacing is faster than a regular expression."""
    text = text_of(col)
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def count_words(col: Column) -> Column:
    return F.regexp_count(text_of(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def long_array(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def count_below(bounds: list[int], value: Column, including: bool = False) -> Column:
    """How many of the ascending ``bounds`` are below ``value`` (or equal to it): a binary search."""
    if not bounds:
        return F.lit(0)
    array = long_array(bounds)
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])

    def step(low: Column, half: Column) -> Column:
        bound = F.get(array, low + half - 1)
        return F.when(bound <= value if including else bound < value, low + half).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def window_hashes(words: Column, width: int) -> Column:
    """64-bit hash of every run of ``width`` words, in order; empty if there are fewer.

    ``words`` are word hashes. Runs are built by joining a run with the next word's hash.
    """
    runs = words
    for k in range(1, width):
        n = F.greatest(F.size(words) - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), n), F.slice(words, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))
    return runs


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; lambdas would evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(col: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text_of(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Ids that are broadcast at most: 16 MB with their hashes.
BROADCAST_IDS = 1 << 20
#: Rows of an Arrow batch of whole texts; Spark's default of 10,000 takes hundreds of MB.
ARROW_ROWS = "1000"


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs`` as they are; Python tasks of the session get batches of ``ARROW_ROWS``, unless it sets a size itself."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, ARROW_ROWS)
    return docs


def listed_in(ids: DataFrame, name: str) -> DataFrame:
    """``ids`` stored, and marked for a broadcast if they are at most ``BROADCAST_IDS``; beyond, joins shuffle."""
    held = stored(ids, name)
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in the one column of ``ids``; null ids stay."""
    gone = listed_in(ids.toDF("gone").filter("gone is not null"), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def without_rows(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` without those of ``rows``, given as doc_id and the value of ``key``, a hash of what they hold."""
    gone = listed_in(rows.toDF("gone_id", "gone_key").distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (key == gone["gone_key"]), "left_anti")


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Of the rows that share an id the least one; rows without an id all stay.

    Ids are counted without their rows, and only the rows of repeated ids are grouped, combined map-side.
    """
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    again = listed_in(repeated.select(F.col("doc_id").alias("again")), "repeated")
    is_again = docs["doc_id"] == again["again"]
    least = docs.join(again, is_again, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return docs.join(again, is_again, "left_anti").union(least.select("row.*"))
