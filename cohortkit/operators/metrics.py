"""Ranking metrics. Scores are grouped first, so ties share one curve point and one threshold.

Every function takes rows of (y_true 0/1, score) and an optional ``by`` column that names the model. The
grouped scores are written once when a function is called, so the call itself runs a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.running import running_totals


def score_table(scores: DataFrame, by: str | None = None, y_true: str = "y_true", score: str = "score", slices: int | None = None, lead: bool = False) -> DataFrame:
    """Per distinct score, from the highest: positives ``tp``, negatives ``fp``, running and whole totals."""
    group = [by] if by else []
    checked = F.when(F.col(score).isNull() | F.isnan(F.col(score).cast("double")) | F.col(y_true).isNull(), F.raise_error(F.lit("score and label must not be missing"))).otherwise(F.col(score))
    counts = (
        scores.select(*group, (F.col(y_true) == 1).cast("bigint").alias("_positive"), checked.alias("threshold"))
        .groupBy(*group, "threshold")
        .agg(F.sum("_positive").alias("tp"), F.sum(1 - F.col("_positive")).alias("fp"))
    )
    return running_totals(counts, [("threshold", True)], ["tp", "fp"], by=group, lead=["tp", "fp"] if lead else (), slices=slices)


def precision_recall_at_k(scores: DataFrame, sizes: Sequence[int], by: str | None = None, slices: int | None = None, **columns) -> DataFrame:
    """Precision, recall and threshold when the ``k`` highest scores are called positive, for each k.

    Every score at or above the k-th highest is called positive, so ties go past k. A size beyond the
    number of rows gives no row.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("sizes must be positive")
    table = score_table(scores, by, slices=slices, **columns)
    reached = F.col("cum_tp") + F.col("cum_fp")
    passed = reached - F.col("tp") - F.col("fp")
    wanted = F.array(*[F.lit(int(k)).cast("bigint") for k in dict.fromkeys(sizes)])
    return (
        table.withColumn("k", F.explode(F.filter(wanted, lambda k: (k > passed) & (k <= reached))))
        .select(
            *([by] if by else []),
            "k",
            (F.col("cum_tp") / reached).alias("precision"),
            F.when(F.col("all_tp") > 0, F.col("cum_tp") / F.col("all_tp")).otherwise(F.lit(0.0)).alias("recall"),
            "threshold",
        )
    )


def pr_curve(scores: DataFrame, by: str | None = None, slices: int | None = None, **columns) -> DataFrame:
    """One point per distinct score, and the end point (precision 1, recall 0) without threshold."""
    group = [by] if by else []
    table = score_table(scores, by, slices=slices, **columns)
    recall = F.when(F.col("all_tp") > 0, F.col("cum_tp") / F.col("all_tp")).otherwise(F.lit(1.0))
    threshold_type = table.schema["threshold"].dataType
    point = F.struct("threshold", (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"), recall.alias("recall"))
    end = F.struct(F.lit(None).cast(threshold_type).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    # The row of the lowest score closes its group and brings the end point along.
    last = (F.col("cum_tp") == F.col("all_tp")) & (F.col("cum_fp") == F.col("all_fp"))
    points = F.when(last, F.array(point, end)).otherwise(F.array(point))
    return table.select(*group, F.explode(points).alias("point")).select(*group, "point.*")


def roc_curve(scores: DataFrame, by: str | None = None, drop_intermediate: bool = True, slices: int | None = None, **columns) -> DataFrame:
    """False and true positive rate per distinct score, and the start point (0, 0) without threshold.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours. The rates are
    NULL when a group has no row of the class.
    """
    group = [by] if by else []
    table = score_table(scores, by, slices=slices, lead=drop_intermediate, **columns)
    first = (F.col("cum_tp") == F.col("tp")) & (F.col("cum_fp") == F.col("fp"))
    kept = F.lit(True)
    if drop_intermediate:
        kept = first | F.col("next_tp").isNull() | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
    threshold_type = table.schema["threshold"].dataType
    point = F.struct(
        "threshold",
        (F.col("cum_fp") / F.when(F.col("all_fp") > 0, F.col("all_fp"))).alias("fpr"),
        (F.col("cum_tp") / F.when(F.col("all_tp") > 0, F.col("all_tp"))).alias("tpr"),
    )
    # The row of the highest score opens its group and brings the start point along.
    start = F.struct(F.lit(None).cast(threshold_type).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(first, F.array(start, point)).otherwise(F.array(point))
    return table.where(kept).select(*group, F.explode(points).alias("point")).select(*group, "point.*")


def areas(scores: DataFrame, by: str | None = None, slices: int | None = None, **columns) -> DataFrame:
    """Average precision and area under the ROC curve from one score table.

    Average precision is the sum of precision times the rise in recall, 0 without positives. The ROC area
    is taken by trapezoids, NULL when a group lacks one of the classes.
    """
    table = score_table(scores, by, slices=slices, **columns)
    rise = F.col("tp") / F.when(F.col("all_tp") > 0, F.col("all_tp"))
    step = rise * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    # Doubled trapezoids stay whole numbers, so they add up exactly.
    doubled = F.col("fp").cast("decimal(38,0)") * (2 * F.col("cum_tp") - F.col("tp"))
    pairs = F.max("all_tp").cast("double") * F.max("all_fp")
    return table.groupBy(*([by] if by else [])).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"),
        (F.sum(doubled).cast("double") / F.when(pairs > 0, 2 * pairs)).alias("roc_auc"),
    )


def average_precision(scores: DataFrame, by: str | None = None, slices: int | None = None, **columns) -> DataFrame:
    return areas(scores, by, slices, **columns).drop("roc_auc")


def roc_auc(scores: DataFrame, by: str | None = None, slices: int | None = None, **columns) -> DataFrame:
    return areas(scores, by, slices, **columns).drop("average_precision")
