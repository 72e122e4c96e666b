from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import probability as P
from ebbtide.functions import scalars as S
from ebbtide.functions import text as X
from ebbtide.operators import cleaning, quantiles, signals, stability, validation
from ebbtide.operators.history import trailing_mean


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_ratios_are_null_safe(spark):
    df = spark.createDataFrame([(10.0, 0.0), (20.0, 5.0), (None, 1.0)], "a double, b double")
    assert values(df, S.ratio(F.col("a"), F.col("b"))) == [None, 4.0, None]
    safe = values(df.limit(2), S.epsilon_ratio(F.col("a"), F.col("b")))
    assert all(math.isfinite(v) for v in safe)


def test_log_difference(spark):
    rows = [(1.0, 0.0), (10.0, 1.0), (100.0, 10.0), (-5.0, 3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = values(df, S.log_difference(F.col("a"), F.col("b")))
    want = [math.log1p(max(a, 0)) - math.log1p(max(b, 0)) if a is not None else None for a, b in rows]
    assert got[:4] == pytest.approx(want[:4]) and got[4] is None


def test_age_is_floored_and_may_be_negative(spark):
    df = spark.sql(
        "SELECT DATE'2024-01-01' AS m, TIMESTAMP_NTZ'2024-01-15 12:00:00' AS f UNION ALL "
        "SELECT DATE'2024-04-01', TIMESTAMP_NTZ'2024-01-15 12:00:00'"
    )
    first, later = values(df, S.age_months(F.col("m"), F.col("f")))
    assert first == round(-15 / 30, 1) and later == round(76 / 30, 1)


def test_month_text_round_trip(spark):
    df = spark.createDataFrame([("2024-03",), ("bad",), (None,)], "m string")
    got = values(df, S.period_text(S.parse_month(F.col("m"))))
    assert got == ["2024-03", None, None]


def test_naive_timestamp(spark):
    rows = [("2019-10-01 00:00:01 UTC",), ("2019-10-01 00:00:01",), ("nonsense",), (None,)]
    got = values(spark.createDataFrame(rows, "t string"), S.naive_timestamp(F.col("t")).cast("string"))
    assert got == ["2019-10-01 00:00:01", "2019-10-01 00:00:01", None, None]


def test_unix_round_trip_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1_303_862_400,), (0,)], "s bigint")
        ts = S.timestamp_from_unix(F.col("s"))
        assert values(df, S.unix_from_timestamp(ts)) == [1_303_862_400, 0]
        assert values(df, S.period_start(ts).cast("string")) == ["2011-04-01", "1970-01-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("nan"), 2), (1.5, 3)], "a double, b int")
    assert values(S.nullify_non_finite(df), "a") == [None, None, 1.5]


def test_text_statistics(spark):
    text = "This was AWFUL! broken broken?\tjunk. refund É"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    out = df.select(*[c.alias(n) for n, c in X.text_statistics(F.col("t")).items()]).collect()
    words = text.lower().split()
    row = out[0]
    assert row["review_length"] == len(text) and row["word_count"] == len(words)
    assert row["lexical_diversity"] == pytest.approx(len(set(words)) / len(words))
    assert row["complaint_keyword_count"] == sum(w in specs.COMPLAINT_WORDS for w in words)
    assert row["question_count"] == 1 and row["exclamation_count"] == 1
    assert row["caps_ratio"] == pytest.approx(sum(c.isupper() for c in text) / len(text))
    for empty in out[1:]:
        assert empty["word_count"] == 1 and empty["lexical_diversity"] == 0 and empty["caps_ratio"] == 0


def test_composed_text(spark):
    df = spark.createDataFrame([("sum", "x" * 600), (None, "body"), ("", "body")], "s string, t string")
    got = values(df, X.compose(F.col("s"), F.col("t")))
    assert got == [("sum. " + "x" * 600)[:512], "body", "body"]


def test_uncertainty_examples(spark):
    df = spark.createDataFrame([([0.05, 0.10, 0.85],), ([0.35, 0.35, 0.30],)], "p array<double>")
    assert values(df, P.confidence_band(P.top_probability(F.col("p")))) == ["high", "low"]
    assert values(df, P.needs_review(F.col("p"))) == [False, True]
    assert values(df, P.arg_max(F.col("p"))) == [2, 0]


def test_reliability_bins_match_exact_edges(spark):
    points = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.6000000000000001, 0.7, 0.9, 0.95, 1.0]
    df = spark.createDataFrame([(p,) for p in points], "c double")
    edges = np.linspace(0, 1, 11)
    want = [min(int((edges[1:-1] <= p).sum()), 9) for p in points]
    assert values(df, P.reliability_bin(F.col("c"))) == want


def test_risk_scores(spark):
    df = spark.createDataFrame(
        [("high_fatigue", 0.9), ("moderate_fatigue", 0.5), ("healthy", 0.8), ("fatigued", 1.0)], "c string, p double"
    )
    assert values(df, P.risk_score(F.col("c"), F.col("p"))) == [97.2, 57.0, 13.6, 69.0]


def test_validation_ranges(spark):
    ranges = {"a": (0, 1), "b": (None, 5)}
    df = spark.createDataFrame([(0.5, 5.0), (-1.0, 6.0), (None, 1.0)], "a double, b double")
    out = validation.validate(df, ranges).collect()
    assert [r["violations"] for r in out] == [[], ["a", "b"], []]
    assert [r["accepted"] for r in out] == [True, False, True]


def test_strict_split_quarantines_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    good, bad = validation.strict_split(df, ["a", "b"])
    assert good.count() == 1 and bad.count() == 1


@pytest.mark.parametrize("accuracy,inside", [(10_000, 1_000_000), (50, 1_000_000), (50, 5)])
def test_quantiles_equal_pandas(spark, monkeypatch, accuracy, inside):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MAX_INSIDE", inside)
    rng = np.random.default_rng(1)
    n = 5003
    pdf = pd.DataFrame({
        "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 1.0, rng.lognormal(size=n)), "g": rng.choice(["x", "y"], n),
    })
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    asks = [(c, p) for c in ("a", "b", "hot") for p in (0, 0.01, 0.33, 0.5, 0.999, 1)]
    got = quantiles.quantile_values(df, asks)
    for c, p in asks:
        assert got[(c, float(p))] == pytest.approx(pdf[c].quantile(p), rel=1e-9, abs=1e-12)
    if inside > 5:
        grouped = quantiles.quantile_values(df, asks, ["g"])
        for g, part in pdf.groupby("g"):
            for c, p in asks:
                assert grouped[(c, float(p), g)] == pytest.approx(part[c].quantile(p), rel=1e-9, abs=1e-12)


def test_quantile_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert quantiles.quantile_values(df, [("a", 0.5)]) == {("a", 0.5): None}


def test_keep_first_and_filters(spark):
    rows = [("p", "u", 5, 20, "s", "t"), ("p", "u", 4, 10, "s", "t"), ("p", "v", 9, 1, "s", "t"), ("p", "w", 3, 1, "s", None)]
    df = spark.createDataFrame(rows, "ProductId string, UserId string, Score int, Time bigint, Summary string, Text string")
    out = cleaning.clean_reviews(df).collect()
    assert [(r["UserId"], r["Time"]) for r in out] == [("u", 10)]


def test_sales_filters(spark):
    rows = [("1", "a", 5.0, 1.0, 7), ("C2", "a", 5.0, 1.0, 7), ("3", "a", -1.0, 1.0, 7), ("4", "a", 5.0, 0.0, 7), ("5", "a", 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "Invoice string, StockCode string, Quantity double, Price double, CustomerID bigint")
    assert [r["Invoice"] for r in cleaning.valid_sales(df).collect()] == ["1"]


@pytest.fixture(scope="module")
def ragged():
    rng = np.random.default_rng(3)
    rows = []
    for product in "abcdef":
        for m in sorted(rng.choice(30, rng.integers(1, 14), replace=False)):
            value = float(rng.integers(0, 6)) if rng.random() > 0.15 else None
            rows.append((product, pd.Timestamp("2020-01-01") + pd.DateOffset(months=int(m)), value))
    pdf = pd.DataFrame(rows, columns=["StockCode", "month", "x"])
    pdf["month"] = pdf["month"].dt.date
    return pdf


def test_window_signals_equal_pandas(spark, ragged):
    rows = [(a, m, None if pd.isna(x) else float(x)) for a, m, x in ragged.itertuples(index=False)]
    df = spark.createDataFrame(rows, "StockCode string, month date, x double")
    w = signals.series(specs.SALES)
    x = F.col("x")
    got = df.select(
        "StockCode", "month", signals.difference(x, w).alias("diff"), signals.percent_change(x, w).alias("pct"),
        signals.rolling_std(x, w).alias("std"), trailing_mean(x, w).alias("trail"),
    ).toPandas().sort_values(["StockCode", "month"]).reset_index(drop=True)
    ordered = ragged.sort_values(["StockCode", "month"]).reset_index(drop=True)
    g = ordered.groupby("StockCode")["x"]
    want = pd.DataFrame({
        "diff": g.transform(lambda s: s.diff()),
        "pct": g.transform(lambda s: s.pct_change(fill_method=None) * 100).replace([np.inf, -np.inf], np.nan),
        "std": g.transform(lambda s: s.rolling(3, min_periods=1).std()),
        "trail": g.transform(lambda s: s.shift(1).rolling(3, min_periods=2).mean()),
    })
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_capping_keeps_null_and_never_exceeds_the_maximum(spark):
    df = spark.createDataFrame([(0.01,), (0.5,), (1.0,), (50.0,), (1000.0,), (None,)], "a_rate double")
    out = values(stability.cap(df, stability.cap_bounds(df, ["a_rate"])), "a_rate")
    assert max(v for v in out if v is not None) <= 1000.0 and out[-1] is None
    assert out[0] == pytest.approx(pd.Series([0.01, 0.5, 1, 50, 1000]).quantile(0.01))


def test_age_deviation_skips_negative_ages_and_flat_stages(spark):
    rows = [(-1.0, 5.0), (1.0, 2.0), (2.0, 2.0), (13.0, 1.0), (14.0, 3.0), (30.0, 9.0)]
    df = spark.createDataFrame(rows, "product_age_months double, x double")
    got = {r["product_age_months"]: r["x_age_dev"] for r in stability.age_deviations(df, ["x"]).collect()}
    assert got[-1.0] is None and got[1.0] == 0 and got[30.0] is None
    assert got[13.0] == pytest.approx(-1 / math.sqrt(2))


def test_dead_and_correlated_columns(spark):
    rows = [(float(i), 2.0 * i, 1.0, None if i else 1.0, float((i * 7) % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, empty double, other double")
    cols = df.columns
    dead = stability.listed(stability.dead_columns(df, cols), cols)
    assert dead == ["flat", "empty"]
    assert stability.listed(stability.correlated_columns(df, ["a", "b", "other"]), cols) == ["b"]
