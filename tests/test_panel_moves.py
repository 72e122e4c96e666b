"""What the panels move: one shuffle of the rows for marks and sums, hash tables for first reviews, narrow keys of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import scalars as S
from ebbtide.operators import cleaning, panel
from ebbtide.sources import adapters


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_marked_rows_are_shuffled_once(spark):
    rows = [("a", k % 3, f"i{k % 5}", k % 4 or None, float(k)) for k in range(40)]
    frame = spark.createDataFrame(rows, "p string, m int, o string, c int, v double")
    out = panel.with_distinct(frame, ["p", "m"], {"_c": "c", "_o": "o"}).groupBy("p", "m").agg(
        F.count("_c").alias("c"), F.count("_o").alias("o"), F.count("*").alias("n"), F.sum("v").alias("v"))
    before = plan(out)
    assert before.count("Exchange") == 1 and "Union" not in before
    told = frame.groupBy("p", "m").agg(F.countDistinct("c").alias("c"), F.countDistinct("o").alias("o"), F.count("*").alias("n"), F.sum("v").alias("v"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, told.collect()))


def test_first_ratings_are_combined_in_hash_tables(spark):
    rows = [("p", "u", 1, t, s) for t, s in ((20, 5), (10, 4), (10, 2), (30, 1))]
    rows += [("p", "v", 1, None, 3), ("p", "v", 1, 5, 1), (None, "u", 1, -7, 5), (None, "u", 1, -7, 4), ("p", "u", None, 1, 1), ("p", "w", 2, 1, 9), ("q", None, 2, 0, 1)]
    df = spark.createDataFrame(rows, "ProductId string, UserId string, TextKey bigint, Time bigint, Score int")
    out = cleaning.clean_reviews(df, "TextKey")
    valid = cleaning.valid_scores(cleaning.drop_missing_text(df, "TextKey"))
    told = cleaning.keep_first(valid, ["ProductId", "UserId", "TextKey"], ["Time"])
    assert out.schema.simpleString() == told.schema.simpleString() and set(map(tuple, out.collect())) == set(map(tuple, told.collect()))
    assert ("p", "u", 1, 10, 2) in set(map(tuple, out.collect())) and "SortAggregate" not in plan(out)


def test_median_of_ratings_from_their_counts(spark):
    rows = [(g, s) for g, scores in enumerate(([1], [1, 2], [5, 1, 4, 4], [3, None, 3, 5], [None], [2, 2, 5, 5, 5], [1, 5])) for s in scores]
    df = spark.createDataFrame(rows, "g int, Score int")
    out = df.groupBy("g").agg(S.median_rating(df, "Score").alias("m"), F.median("Score").alias("told"))
    assert all(r["m"] == r["told"] for r in out.collect()) and "ObjectHash" not in plan(df.groupBy("g").agg(S.median_rating(df, "Score")))
    halves = spark.createDataFrame([(1.5,), (2.5,)], "Score double")
    assert halves.agg(S.median_rating(halves, "Score")).first()[0] == 2.0


def test_a_text_is_known_by_its_least_document(spark):
    documents = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, None)], "doc_id bigint, text string")
    orders = spark.sql("SELECT id AS o_orderkey, id AS o_custkey, timestamp_ntz'2020-01-05' AS o_orderdate, '3-MEDIUM' AS o_orderpriority FROM range(8)")
    lines = spark.sql("SELECT id % 8 AS l_orderkey, id AS l_partkey FROM range(16)")
    brands = spark.sql("SELECT id AS p_partkey, concat('b', id % 2) AS p_brand FROM range(15)")
    log = adapters.reviews_log(lines, orders, documents)
    assert dict(log.select("doc_id", "TextKey").distinct().collect()) == {0: 0, 1: 1, 2: 0, 3: None} and log.count() == 16
    assert adapters.reviews_log(lines, orders, documents, brands).groupBy("ProductId").count().collect().__len__() == 2
