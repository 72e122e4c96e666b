"""Distinct counts of the panels and rows dealt out by their number."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ebbtide import session
from ebbtide.operators import panel, stability


def test_distinct_counts_do_not_multiply_the_rows(spark):
    rows = [("a", 1, "i1", 7, 2.0), ("a", 1, "i1", None, 3.0), ("a", 1, "i2", 7, None), ("a", 1, None, 8, 1.0), (None, 1, "i1", 9, 4.0), (None, 1, None, None, 5.0)]
    frame = spark.createDataFrame(rows, "p string, m int, o string, c int, v double")
    marked = panel.with_distinct(frame, ["p", "m"], {"_c": "c", "_o": "o"}).groupBy("p", "m").agg(
        F.sum("v").alias("v"), F.count("_c").alias("c"), F.count("_o").alias("o"), F.avg("v").alias("mean"),
    )
    assert {tuple(r) for r in marked.collect()} == {("a", 1, 6.0, 2, 2, 2.0), (None, 1, 9.0, 1, 1, 4.5)}
    assert "Expand" not in marked._jdf.queryExecution().executedPlan().toString()


def test_panels_aggregate_without_expanding_rows(spark):
    day = dt.datetime(2020, 1, 5)
    lines = [(f"i{k // 2}", "p", 1.0 + k % 3, day + dt.timedelta(days=30 * (k % 8)), 2.0 + k % 5, k % 4) for k in range(64)]
    sales = spark.createDataFrame(lines, "Invoice string, StockCode string, Quantity double, InvoiceDate timestamp, Price double, CustomerID int")
    out = panel.sales_panel(sales)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() >= 6


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    assert session.dealt(spark.range(100), 100, "id").rdd.getNumPartitions() == 11


def test_dead_columns_read_the_panel_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(stability, "stored", lambda df, name: made.append(name) or df.localCheckpoint())
    frame = spark.createDataFrame([(1.0, float(k), None) for k in range(20)], "a double, b double, c double")
    assert {r["column"] for r in stability.dead_columns(frame, ["a", "b", "c"]).collect()} == {"a", "c"} and made == ["dead-columns"]
