"""Per-key prediction metrics: TP, CP, PCP, precision, recall, F1.

``basket_metrics`` is the DataFrame form of the reference's metric function:
one groupBy over rows of (key, truth, prediction) flags, where TP counts rows
with both flags 1, CP sums the truth and PCP the prediction.  Guarded ratios
are 0 when their denominator is 0 and F1 is 0 when precision or recall is
0; the unguarded variant leaves undefined ratios NULL (R's NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["tp", "cp", "pcp", "precision", "recall", "f1"]


def metric_counts(truth: Column, pred: Column) -> list[Column]:
    """TP, CP, PCP aggregate expressions over 0/1 flag columns."""
    return [
        F.count_if((truth == 1) & (pred == 1)).alias("tp"),
        F.coalesce(F.sum(truth), F.lit(0)).cast("bigint").alias("cp"),
        F.coalesce(F.sum(pred), F.lit(0)).cast("bigint").alias("pcp"),
    ]


def ratio_columns(tp: Column, cp: Column, pcp: Column, guarded: bool = True) -> list[Column]:
    """precision, recall, f1 from the three counts."""
    if guarded:
        precision = F.when(pcp == 0, F.lit(0.0)).otherwise(F.try_divide(tp, pcp))
        recall = F.when(cp == 0, F.lit(0.0)).otherwise(F.try_divide(tp, cp))
        f1 = F.when((precision == 0) | (recall == 0), F.lit(0.0)).otherwise(
            F.try_divide(F.lit(2) * precision * recall, precision + recall)
        )
    else:
        precision = F.try_divide(tp, pcp)
        recall = F.try_divide(tp, cp)
        f1 = F.try_divide(F.lit(2) * precision * recall, precision + recall)
    return [
        precision.cast("double").alias("precision"),
        recall.cast("double").alias("recall"),
        f1.cast("double").alias("f1"),
    ]


def with_ratios(counts: DataFrame, guarded: bool = True) -> DataFrame:
    """Append precision/recall/f1 to a frame holding tp, cp, pcp."""
    return counts.select(
        "*", *ratio_columns(F.col("tp"), F.col("cp"), F.col("pcp"), guarded)
    )


def basket_metrics(
    df: DataFrame,
    key: str | list[str] = "user_id",
    truth: str = "y_act",
    pred: str = "y_hat",
    guarded: bool = True,
) -> DataFrame:
    """One row per key with tp, cp, pcp, precision, recall, f1.

    Aggregation is partial (map-side) before the shuffle on ``key``, so a
    key holding a large share of rows is reduced to one row per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*keys).agg(*metric_counts(F.col(truth), F.col(pred)))
    return with_ratios(counts, guarded).select(*keys, *METRICS)
