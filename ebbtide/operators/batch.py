"""Scoring whole tables with a prepared model: alignment, policy, uncertainty and scenarios."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide import specs
from ebbtide.functions import probability as P
from ebbtide.operators import scoring, validation
from ebbtide.operators.calibration import Calibrator
from ebbtide.operators.models import Classifier
from ebbtide.operators.prep import Prepared


@dataclass(frozen=True)
class Scorer:
    """Everything needed to score raw panel rows of one source."""

    source: str
    prepared: Prepared
    classifier: Classifier
    calibrator: Calibrator | None = None
    clusters: Any = None
    threshold: float = 0.5
    weights: Mapping[str, float] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [c for c in self.prepared.features if not c.startswith("lifecycle_stage_")]

    def score(self, rows: DataFrame, explained: bool = True) -> DataFrame:
        """Rows with probabilities, class, confidence, band, warnings, completeness, cluster and top contributions."""
        keep = rows.columns
        have = [c for c in self.required if c in rows.columns]
        share = (
            sum(F.col(c).isNotNull().cast("int") for c in have) / F.lit(len(self.required))
            if have else F.lit(0.0)
        )
        raw = {f"_raw_{c}": F.col(c) for c in keep}
        aligned = self.prepared.align(rows.withColumns({**raw, "completeness": share}))
        scored = self.classifier.predict(aligned)
        p = "p"
        if self.calibrator is not None:
            scored = self.calibrator.apply(scored, "p", "q")
            p = "q"
        if self.clusters is not None:
            scored = self.clusters.transform(scored)
        if explained:
            scored = self.classifier.explain(scored, self.prepared.features)
        cluster = F.col("cluster") if self.clusters is not None else F.lit(None).cast("int")
        pred = P.decide(F.col(p), self.prepared.classes, self.weights, self.threshold)
        classes = F.array(*[F.lit(c) for c in self.prepared.classes])
        told = ["top_features"] if explained else []
        final = scored.select(
            *[F.col(f"_raw_{c}").alias(c) for c in keep], "completeness",
            F.col("p").alias("raw_probabilities"), F.col(p).alias("probabilities"),
            pred.alias("pred"), cluster.alias("cluster"), *told,
        ).withColumn(
            "confidence", F.get("probabilities", F.array_position(classes, F.col("pred")).cast("int") - 1)
        )
        if self.source == "reviews":
            final = scoring.snapshot_override(final)
        final = scoring.uncertainty(final, "probabilities").drop("max_probability")
        warnings = F.array_compact(F.array(
            F.when(F.col("uncertainty_flag"), "Prediction flagged as uncertain — consider manual review"),
            F.when(F.array_max("probabilities") > P.OVERCONFIDENT_ABOVE, scoring.RAW_TOO_CONFIDENT),
            F.col("override_warning") if "override_warning" in final.columns else F.lit(None).cast("string"),
        ))
        return scoring.risk(final.withColumn("warnings", warnings))

    def score_strict(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(scored, quarantined) rows: strict scoring takes only sufficiently complete rows."""
        required = [c for c in self.required if c in rows.columns]
        missing = len(required) < len(self.required)
        fine, bad = validation.strict_split(rows, required)
        if missing:
            fine, bad = fine.limit(0), fine.unionByName(bad)
        return self.score(fine.drop("completeness")), bad

    def scenario(self, rows: DataFrame, key: list[str], feature: str, percent: float) -> DataFrame:
        """Risk of every row with one feature moved, next to its own risk."""
        base = self.score(rows, explained=False).select(*key, F.col("risk_score").alias("risk_score"))
        moved = self.score(validation.what_if(rows, feature, percent), explained=False).select(
            *key, F.col("risk_score").alias("scenario_score")
        )
        return base.join(moved, key).withColumn(
            "delta_vs_primary", F.round(F.col("scenario_score") - F.col("risk_score"), 2)
        )


SCENARIO_FEATURE = {"reviews": "review_count", "sales": "revenue_total", "usage": "engagement_total"}
FATIGUE_CLASSES = (specs.HIGH, specs.MODERATE, specs.FATIGUED)
