"""What the panels' rows cost in their tasks: sorts led by the counted column, quantiles of large columns in two scans."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import panel, quantiles


def test_the_counted_column_leads_the_sort(spark):
    rows = [("a", k % 3, f"i{k % 5}" if k % 7 else None, k % 4 or None) for k in range(60)] + [(None, None, "i1", 1), (None, None, "i1", 2), ("a", None, None, None)]
    frame = spark.createDataFrame(rows, "p string, m int, o string, c int")
    out = panel.with_distinct(frame, ["p", "m"], {"_c": "c", "_o": "o"})
    sorts = re.findall(r"Sort \[(\w+)#", out._jdf.queryExecution().executedPlan().toString())
    assert sorted(sorts) == ["c", "o"]
    counted = out.groupBy("p", "m").agg(F.count("_c"), F.count("_o"), F.count("*"))
    told = frame.groupBy("p", "m").agg(F.countDistinct("c"), F.countDistinct("o"), F.count("*"))
    assert set(map(tuple, counted.collect())) == set(map(tuple, told.collect())) and out.count() == len(rows)


@pytest.mark.parametrize("p", [0.25, 0.5, 0.999])
def test_quantiles_of_large_columns_take_two_scans(spark, monkeypatch, p):
    values = np.random.default_rng(3).normal(size=4001)
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    scans, run = [], quantiles._run
    run_by = quantiles._run_by
    monkeypatch.setattr(quantiles, "MAX_INSIDE", 100)  # the column has more rows, its bracket has not
    monkeypatch.setattr(quantiles, "_run", lambda *a: scans.append(1) or run(*a))
    monkeypatch.setattr(quantiles, "_run_by", lambda *a: scans.append(1) or run_by(*a))
    assert quantiles.quantile_values(df, [("a", p)])[("a", p)] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert len(scans) == 2
