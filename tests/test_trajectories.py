"""Trajectories of the most declining products."""

from __future__ import annotations

from ebbtide.plans import summaries as plans
from ebbtide.plans.base import QUERIES, Tables


def test_trajectories_read_each_panel_once(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(plans, "stored", lambda df, name: made.append((name, len(df.columns))) or df.localCheckpoint())
    row = "sequence(to_timestamp('2020-01-05'), to_timestamp('2020-12-05'), interval 1 month)"
    panel = spark.sql(f"SELECT explode({row}) AS month, 'p' AS ProductId, 'p' AS StockCode, 1 AS product_id").selectExpr(
        "*", "50.0D AS product_age_months", *[f"-90.0D AS {c}" for c in (
            "sentiment_mean", "sentiment_velocity", "revenue_total", "revenue_velocity", "engagement_total", "engagement_velocity", "conversion_rate",
        )],
    )
    monkeypatch.setattr(Tables, "signals", lambda self, source, grain="part": panel)
    out = QUERIES["t3_decline_trajectories"](spark, str(tmp_path))
    assert out.count() == 36 and [n for n, _ in made] == ["trajectories-reviews", "trajectories-sales", "trajectories-usage"]
