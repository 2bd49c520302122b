"""Evaluation of a scored table: label (0/1), prediction (0/1), score in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.ordered import running_sums
from tablemill.session import stage

# Fixed value: probabilities are clipped to [EPS, 1 - EPS] before the logarithm.
EPS = 1e-15


def _log_loss(label: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-F.when(label == 1, F.log(p)).otherwise(F.log(1 - p)))


def classification_metrics(scored: DataFrame, label="label", prediction="prediction", score="score") -> DataFrame:
    """Confusion matrix, precision, recall, F1, accuracy and log loss in one aggregation.

    ``log_loss_hard`` is taken on the 0/1 predictions as published, ``log_loss`` on the scores.
    """
    y, p = F.col(label), F.col(prediction)
    counts = scored.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        _log_loss(y, p.cast("double")).alias("log_loss_hard"), _log_loss(y, F.col(score)).alias("log_loss"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        "log_loss", "log_loss_hard")


def roc_points(scored: DataFrame, label="label", score="score") -> DataFrame:
    """One point per distinct score, highest first: score, tp, fp (running), tpr, fpr.

    Rows are counted per score before anything is ordered; the running totals are taken in
    ranges, so no task sees the whole curve.
    """
    y = F.col(label)
    by_score = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    falling = stage(by_score.withColumn("falling", -F.col("score")), "scores")
    summed = running_sums(falling, [F.col("falling")], "falling", {"tp": F.col("p"), "fp": F.col("n")})
    whole = scored.agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    return summed.select("score", "p", "n", "tp", "fp", (F.col("tp") / whole.select("p").scalar()).alias("tpr"),
                         (F.col("fp") / whole.select("n").scalar()).alias("fpr"))


def roc_area(points: DataFrame) -> DataFrame:
    """Trapezoid area: each score group adds its width times the mean height before and after it."""
    piece = F.col("n") * (2 * F.col("tp") - F.col("p"))
    return points.agg((F.sum(piece) / (2 * F.sum("p") * F.sum("n"))).alias("auc"))


def run_summary(scored: DataFrame, **facts) -> DataFrame:
    """One row describing a run: metrics, area, size and the given facts."""
    metrics = classification_metrics(scored)
    area = roc_area(roc_points(scored)).scalar()
    size = scored.agg(F.count(F.lit(1))).scalar()
    return metrics.withColumns({"roc_auc": area, "test_item_count": size, **{k: F.lit(v) for k, v in facts.items()}})


def run_record(scored: DataFrame, rows: Column, target: str, parameters: dict, importances: dict, run_seconds: float, analysis: list[str], **facts) -> DataFrame:
    """``run_summary`` with what else a run leaves behind: its input, settings, importances, lines of analysis, time and date."""
    listed = lambda d: ", ".join(f"{k}={v}" for k, v in d.items())
    return run_summary(scored, target=target, parameters=listed(parameters), importances=listed(importances), analysis="; ".join(analysis),
                       run_seconds=float(run_seconds), **facts).withColumns({"row_count": rows, "created_at": F.current_timestamp()})
