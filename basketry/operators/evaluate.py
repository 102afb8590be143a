"""Evaluation: prediction/truth joins, metric tables, sweeps.

Threshold sweeps (top-N for N = 1..10, probability cutoffs 0.10..0.23) are
computed in ONE aggregation per key: for every threshold i the aggregation
holds ``pcp_i = count_if(predicted at i)`` and ``tp_i = count_if(predicted
at i and true)``, next to ``cp = sum(truth)``.  The per-key row is then
unpivoted into one row per threshold.  No candidate row is replicated per
threshold and there is no join with a parameter grid.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.metrics import METRICS, basket_metrics, ratio_columns
from basketry.functions.stats import six_number_summary

# The reference's cutoff grid seq(0.10, 0.23, by = 0.01), built
# from integers (k / 100) so that every engine sees the same doubles.
CUTOFF_PERCENTS = list(range(10, 24))
DEFAULT_CUTOFF = 0.21


def cutoffs() -> list[float]:
    return [k / 100 for k in CUTOFF_PERCENTS]


def join_prediction_truth(
    pred: DataFrame,
    truth: DataFrame,
    pred_col: str = "y_hat",
    truth_col: str = "y_act",
    keys: tuple[str, ...] = ("user_id", "product_id"),
) -> DataFrame:
    """Full outer join of predictions and truth on ``keys``, missing flags
    filled with 0 (J7).  Both sides hold one row per key, so the join is
    expressed as a union followed by a hash aggregation: no sort, and a user
    with many products is spread over tasks by the (user, product) hash."""
    p = pred.select(*keys, F.col(pred_col).alias("_p"), F.lit(None).cast("int").alias("_t"))
    t = truth.select(*keys, F.lit(None).cast("int").alias("_p"), F.col(truth_col).alias("_t"))
    return (
        p.unionByName(t)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.max("_p"), F.lit(0)).alias(pred_col),
            F.coalesce(F.max("_t"), F.lit(0)).alias(truth_col),
        )
    )


def labelled_metrics(
    df: DataFrame,
    key: str,
    truth: Column,
    cases: list[tuple[dict[str, Column], Column]],
    guarded: bool = True,
) -> DataFrame:
    """Metrics of several predictions at once, one row per (case, key).

    ``cases`` pairs label columns (e.g. ``{"benchmark": lit("top_n"), "n":
    lit(3)}``) with the boolean "predicted" column of that case.  ONE
    aggregation per key holds ``cp = sum(truth)`` and, per case,
    ``pcp_i = count_if(predicted)`` and ``tp_i = count_if(predicted and
    true)``; the per-key row is then unpivoted.  Output: label columns,
    key, tp, cp, pcp, precision, recall, f1."""
    labels = list(cases[0][0])
    aggs = [F.coalesce(F.sum(truth), F.lit(0)).cast("bigint").alias("cp")]
    for i, (_, cond) in enumerate(cases):
        aggs.append(F.count_if(cond).alias(f"pcp_{i}"))
        aggs.append(F.count_if(cond & (truth == 1)).alias(f"tp_{i}"))
    wide = df.groupBy(key).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                *[lab[name].alias(name) for name in labels],
                F.col(f"tp_{i}").alias("tp"),
                F.col(f"pcp_{i}").alias("pcp"),
            )
            for i, (lab, _) in enumerate(cases)
        ]
    )
    long = wide.select(key, "cp", F.inline(rows))
    return long.select(
        *labels,
        key,
        "tp",
        "cp",
        "pcp",
        *ratio_columns(F.col("tp"), F.col("cp"), F.col("pcp"), guarded),
    )


def sweep_metrics(
    df: DataFrame,
    key: str,
    truth: Column,
    thresholds: list[tuple[object, Column]],
    label: str,
    label_type: str,
    guarded: bool = True,
) -> DataFrame:
    """Metrics per (threshold, key) for a family of nested predictions
    (``labelled_metrics`` with one label column)."""
    cases = [({label: F.lit(value).cast(label_type)}, cond) for value, cond in thresholds]
    return labelled_metrics(df, key, truth, cases, guarded)


def cutoff_thresholds(score: Column) -> list[tuple[float, Column]]:
    """Strict ``score > cutoff`` for each cutoff of the grid."""
    return [(c, score > F.lit(c)) for c in cutoffs()]


def mean_f1(metrics: DataFrame) -> DataFrame:
    """V5: number of keys and mean F1."""
    return metrics.agg(F.count(F.lit(1)).alias("users"), F.avg("f1").alias("mean_f1"))


def metric_summary(metrics: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A10/V6: six statistics x six metrics (optionally per group)."""
    return six_number_summary(metrics, METRICS, group_cols)


# ------------------------------------------------------------- candidate scores


def order_metrics(
    scored: DataFrame,
    cutoff: float = DEFAULT_CUTOFF,
    score: str = "score",
    guarded: bool = True,
) -> DataFrame:
    """V3/V4: metrics per target order over candidate rows only, label =
    reordered, prediction = score > cutoff."""
    return basket_metrics(
        scored.select(
            "order_id",
            F.col("reordered").alias("y_act"),
            (F.col(score) > F.lit(cutoff)).cast("int").alias("y_hat"),
        ),
        key="order_id",
        guarded=guarded,
    )


def cutoff_sweep(scored: DataFrame, key: str = "order_id", score: str = "score") -> DataFrame:
    """V7: mean F1 per cutoff over keys (candidates only, label reordered)."""
    per_key = sweep_metrics(
        scored,
        key,
        F.col("reordered"),
        cutoff_thresholds(F.col(score)),
        "cutoff",
        "double",
    )
    return per_key.groupBy("cutoff").agg(F.avg("f1").alias("mean_f1"))


def cutoff_sweep_summary(scored: DataFrame, key: str = "user_id", score: str = "score") -> DataFrame:
    """V8: per cutoff, the six-number summary of every metric over keys."""
    per_key = sweep_metrics(
        scored, key, F.col("reordered"), cutoff_thresholds(F.col(score)), "cutoff", "double"
    )
    return metric_summary(per_key, ["cutoff"])


def config_sweeps(scored: DataFrame, scores: dict[str, Column], key: str = "order_id") -> DataFrame:
    """V7 for several score columns at once: config, cutoff, mean_f1.
    Every (config, cutoff) pair is one case of a single aggregation per
    key, so the candidates are read once for all configurations."""
    cases = [
        ({"config": F.lit(name), "cutoff": F.lit(c).cast("double")}, col > F.lit(c))
        for name, col in scores.items()
        for c in cutoffs()
    ]
    per_key = labelled_metrics(scored, key, F.col("reordered"), cases)
    return per_key.groupBy("config", "cutoff").agg(F.avg("f1").alias("mean_f1"))


def config_comparison(table: DataFrame) -> DataFrame:
    """V9: best cutoff and mean F1 per configuration (ties -> lowest cutoff)
    from a (config, cutoff, mean_f1) table.

    ``max`` over a (f1, -cutoff) struct picks the best row of each config in
    the aggregation itself."""
    best = table.groupBy("config").agg(
        F.max(F.struct(F.col("mean_f1"), (-F.col("cutoff")).alias("neg_cutoff"))).alias("b")
    )
    return best.select(
        "config",
        (-F.col("b.neg_cutoff")).alias("best_cutoff"),
        F.col("b.mean_f1").alias("best_f1"),
    )


def scores_vs_truth(scored: DataFrame, truth_items: DataFrame, score: str = "score") -> DataFrame:
    """Candidate scores full-joined with the ordered truth, so products
    bought for the first time count as misses (score NULL, ordered 0/1)."""
    keys = ["user_id", "product_id"]
    s = scored.select(*keys, F.col(score).alias("score"), F.lit(None).cast("int").alias("_o"))
    t = truth_items.select(*keys, F.lit(None).cast("double").alias("score"), F.col("ordered").alias("_o"))
    return (
        s.unionByName(t)
        .groupBy(*keys)
        .agg(F.max("score").alias("score"), F.coalesce(F.max("_o"), F.lit(0)).alias("ordered"))
    )


def user_metrics_ordered(vs_truth: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """V2: per-user metrics with truth = ordered, prediction = score >
    cutoff (0 for unscored products)."""
    return basket_metrics(
        vs_truth.select(
            "user_id",
            F.col("ordered").alias("y_act"),
            F.coalesce((F.col("score") > F.lit(cutoff)).cast("int"), F.lit(0)).alias("y_hat"),
        ),
        key="user_id",
    )


def threshold_scores(scored: DataFrame, cutoff: float = DEFAULT_CUTOFF, score: str = "score") -> DataFrame:
    """user_id, product_id, score, y_hat = (score > cutoff)."""
    return scored.select(
        "user_id",
        "product_id",
        F.col(score).alias("score"),
        (F.col(score) > F.lit(cutoff)).cast("int").alias("y_hat"),
    )
