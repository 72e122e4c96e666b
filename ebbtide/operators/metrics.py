"""Evaluation metrics as small aggregations over any table of truth, prediction and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import probability as P
from ebbtide.functions import scalars as S
from ebbtide.operators.ranking import running_totals

LEAKAGE_ABOVE = 0.98


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs in truth or prediction."""
    hit = F.col("y") == F.col("pred")
    sides = F.array(
        F.struct(
            F.col("y").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"),
        ),
        F.struct(
            F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("tp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn"),
        ),
    )
    counts = conf.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return counts.select(
        *by, "class", "tp", "fp", "fn", (tp + fn).alias("support"),
        or_zero(S.ratio(tp, tp + fp)).alias("precision"),
        or_zero(S.ratio(tp, tp + fn)).alias("recall"),
        or_zero(S.ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and balanced accuracy per ``by``."""
    classes = per_class(conf, by)
    seen = F.col("support") > 0
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
    )


def evaluate(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    return report(confusion(df, y, pred, by), by)


def macro_f1(df: DataFrame, y: str = "y", pred: str = "pred") -> float:
    row = evaluate(df, (), y, pred).collect()
    return float(row[0]["f1_macro"]) if row and row[0]["f1_macro"] is not None else 0.0


def one_vs_rest(df: DataFrame, classes: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Per class and distinct score: rows and positives, combined before the shuffle."""
    items = F.array(*[
        F.struct(
            F.lit(c).alias("class"), F.get(F.col(p), F.lit(i)).alias("score"),
            (F.col(y) == c).cast("bigint").alias("pos"),
        )
        for i, c in enumerate(classes)
    ])
    return df.select(F.inline(items)).groupBy("class", "score").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")
    )


def auc(df: DataFrame, classes: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve of each class against the rest; ties count half."""
    ranked = running_totals(one_vs_rest(df, classes, p, y), ["class"], "score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ranked.groupBy("class").agg(
        S.ratio(wins, F.first("pos_total") * F.first("neg_total")).alias("auc")
    )


def roc_curve(df: DataFrame, classes: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """True and false positive rates when everything at or above each score is positive."""
    ranked = running_totals(one_vs_rest(df, classes, p, y), ["class"], "score", ["pos", "neg"])
    return ranked.select(
        "class", F.col("score").alias("threshold"),
        S.ratio(F.col("pos_total") - F.col("pos_below"), F.col("pos_total")).alias("tpr"),
        S.ratio(F.col("neg_total") - F.col("neg_below"), F.col("neg_total")).alias("fpr"),
    )


def brier(df: DataFrame, p: str = "p", y_index: str = "y_index") -> DataFrame:
    return df.agg(F.avg(P.brier(F.col(p), F.col(y_index))).alias("brier"))


def reliability(
    df: DataFrame, p: str = "p", y_index: str = "y_index", n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Per confidence bin: mean confidence, accuracy and rows; empty bins are kept."""
    confidence = P.top_probability(F.col(p))
    right = (P.arg_max(F.col(p)) == F.col(y_index)).cast("double")
    filled = df.groupBy(*by, P.reliability_bin(confidence, n_bins).alias("bin")).agg(
        F.avg(confidence).alias("mean_predicted"), F.avg(right).alias("fraction_correct"),
        F.count("*").alias("n_rows"),
    )
    if by:
        return filled
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(filled, "bin", "left").select(
        "bin", (F.col("bin") / n_bins).alias("low"), ((F.col("bin") + 1) / n_bins).alias("high"),
        "mean_predicted", "fraction_correct", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def calibration_error(
    df: DataFrame, p: str = "p", y_index: str = "y_index", n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Row-weighted distance between confidence and accuracy over the bins."""
    bins = reliability(df, p, y_index, n_bins, by)
    gap = F.abs(F.col("fraction_correct") - F.col("mean_predicted")) * F.col("n_rows")
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("n_rows")).alias("ece"))


def distribution_drift(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half the L1 distance between true and predicted class shares."""
    classes = per_class(conf, by)
    gap = F.abs((F.col("tp") + F.col("fn")) - (F.col("tp") + F.col("fp")))
    return classes.groupBy(*by).agg((F.sum(gap) / F.sum("support") / 2).alias("drift"))


def gap_and_leakage(table: DataFrame) -> DataFrame:
    """CV-test gap and leakage flag for rows with ``cv_f1``, ``f1_macro`` and ``accuracy``."""
    return table.withColumns({
        "cv_test_gap": F.col("cv_f1") - F.col("f1_macro"),
        "leakage_flag": F.col("accuracy") > LEAKAGE_ABOVE,
    })


def confidence_summary(df: DataFrame, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and overconfident share of the top probability."""
    top = P.top_probability(F.col(p))
    return df.groupBy(*by).agg(
        F.avg(top).alias("mean_confidence"),
        F.stddev_pop(top).alias("std_confidence"),
        F.count_if(top > P.OVERCONFIDENT_ABOVE).alias("n_overconfident"),
        (F.avg((top > P.OVERCONFIDENT_ABOVE).cast("double")) * 100).alias("overconfident_percent"),
    )


def performance_status(table: DataFrame) -> DataFrame:
    """Status of each result row; later rules overrule earlier ones."""
    f1, gap = F.col("test_f1"), F.col("cv_test_gap")
    in_range = f1.between(0.65, 0.92)
    calm = F.abs(gap) < 0.05
    status = (
        F.when(f1 >= 0.95, "SUSPICIOUS").when(~calm, "GAP_TOO_LARGE")
        .when(~in_range, "OUT_OF_RANGE").otherwise("PASS")
    )
    return table.withColumn("status", status)
