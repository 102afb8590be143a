"""Baseline predictors and their per-user metrics.

Family I  -- target "re-ordered": truth is the train order's reordered
             flag, population is every train user.
Family II -- target "ordered": truth is every product of the train order
             (first-time purchases included), population is the
             validation users of the holdout split.

Every baseline of a family is a flag or a rank over the SAME table: prior
lines and truth rows unioned and aggregated once per (user, product) --
times bought, first order, recency flags and the truth label in one pass
(the full outer join of history and truth without a join).  ``labelled_metrics`` then scores any set of baselines in one
aggregation per user: the leaderboard of all nine baselines (27 rows) is two
aggregations over two merged tables, not nine pipelines.

Top-N asks whether a dense rank among one user's distinct values is at most N:
the user's N largest values are joined back (``with_top_values``), so the rows
are dealt by user once, for the join and for the metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.joins import join_back
from basketry.functions.metrics import METRICS, basket_metrics
from basketry.operators.evaluate import join_prediction_truth, labelled_metrics
from basketry.operators.history import rank_at_most, recent_items, with_orders_back, with_top_values
from basketry.operators.splits import users_in_part
from basketry.sources.tables import BasketTables

TOP_N_MAX = 10
KEYS = ["user_id", "product_id"]


# -------------------------------------------------------------------- inputs


def train_order_users(t: BasketTables) -> DataFrame:
    """Users whose target order is in the train set (from orders)."""
    return t.orders.where(F.col("eval_set") == "train").select("user_id")


def reordered_truth(t: BasketTables) -> DataFrame:
    """Family I truth: user_id, product_id, y_act = reordered."""
    return t.train_items.select("user_id", "product_id", F.col("reordered").alias("y_act"))


def validation_users(t: BasketTables) -> DataFrame:
    return users_in_part(t, "ud")


def ordered_truth(t: BasketTables) -> DataFrame:
    """Family II truth: train items of validation users, y_act = ordered."""
    return t.train_items.join(validation_users(t), "user_id", "left_semi").select(
        "user_id", "product_id", F.col("ordered").alias("y_act")
    )


def _prior_of(t: BasketTables, users: DataFrame) -> DataFrame:
    """Prior items of a user set; the semi join keeps a dominant user
    splittable (``join_back``)."""
    return join_back(t.prior_items, users, ["user_id"], "left_semi")


def _flag(cond: Column) -> Column:
    return F.max(F.when(cond, 1).otherwise(0)).cast("int")


def history_with_truth(prior: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per (user, product) bought in ``prior`` or present in
    ``truth``, from ONE aggregation over the union of prior lines and truth
    rows (the full outer join of history and truth):

    times bought, first order, the user's last prior order number, recency
    flags -- bought in the last order (last1), in the last two (last2),
    re-ordered in the last one / two / three orders (last1_reo, last2_reo,
    last3_reo) --, ``candidate`` = 1 when bought before, and ``y_act`` (the
    truth flag, 0 when absent)."""
    back = F.col("orders_back")
    reo = F.col("reordered") == 1
    lines = with_orders_back(prior).select(
        *KEYS, "order_number", "user_max", "orders_back", "reordered",
        F.lit(None).cast("int").alias("y_act"),
    )
    labels = truth.select(
        *KEYS,
        F.lit(None).cast("int").alias("order_number"),
        F.lit(None).cast("int").alias("user_max"),
        F.lit(None).cast("int").alias("orders_back"),
        F.lit(None).cast("int").alias("reordered"),
        "y_act",
    )
    return (
        lines.unionByName(labels)
        .groupBy(*KEYS)
        .agg(
            F.count("order_number").alias("times"),
            F.min("order_number").alias("first_order"),
            F.max("user_max").alias("user_max"),
            _flag(back == 0).alias("last1"),
            _flag(back <= 1).alias("last2"),
            _flag((back == 0) & reo).alias("last1_reo"),
            _flag((back <= 1) & reo).alias("last2_reo"),
            _flag((back <= 2) & reo).alias("last3_reo"),
            F.when(F.count("order_number") > 0, F.lit(1)).alias("candidate"),
            F.coalesce(F.max("y_act"), F.lit(0)).alias("y_act"),
        )
    )


def family1_table(t: BasketTables, max_n: int = TOP_N_MAX) -> DataFrame:
    """Train users: history flags, the user's largest times bought (ties kept,
    once-bought products unranked), truth = reordered."""
    merged = history_with_truth(_prior_of(t, train_order_users(t)), reordered_truth(t))
    again = merged.withColumn("again", F.when(F.col("times") >= 2, F.col("times")))
    return with_top_values(again, "again", max_n)


def family2_table(t: BasketTables, max_n: int = TOP_N_MAX) -> DataFrame:
    """Validation users: history flags, the user's largest order rates since the
    first order (= up_order_rate_since_first_order), truth = ordered."""
    merged = history_with_truth(_prior_of(t, validation_users(t)), ordered_truth(t))
    rate = F.col("times") / (F.col("user_max") - F.col("first_order") + 1)
    # products never bought before have no rate, hence no rank
    return with_top_values(merged.withColumn("rate", rate), "rate", max_n)


Case = tuple[str, "int | None", Column]  # (benchmark, n, predicted)


def _case(benchmark: str, cond: Column, n: int | None = None) -> Case:
    return (benchmark, n, cond)


def score_cases(table: DataFrame, cases: list[Case]) -> DataFrame:
    """benchmark, n, user_id, metrics for every case, in one aggregation."""
    labelled = [
        ({"benchmark": F.lit(b), "n": F.lit(n).cast("int")}, cond) for b, n, cond in cases
    ]
    return labelled_metrics(table, "user_id", F.col("y_act"), labelled)


def _only(cases: list[Case], benchmark: str) -> list[Case]:
    return [c for c in cases if c[0] == benchmark]


def family1_cases(max_n: int = TOP_N_MAX) -> list[Case]:
    return [
        _case("repeat_last_order", F.col("last1") == 1),
        _case("repeat_last_re_order", F.col("last1_reo") == 1),
        _case("repeat_last_2_re_order", F.col("last2_reo") == 1),
        _case("repeat_last_3_re_order", F.col("last3_reo") == 1),
    ] + [_case("top_n", rank_at_most("again", n), n) for n in range(1, max_n + 1)]


def family2_cases(max_n: int = TOP_N_MAX) -> list[Case]:
    return [
        _case("all_ordered", F.col("candidate") == 1),
        _case("last_order", F.col("last1") == 1),
        _case("last_two_orders", F.col("last2") == 1),
    ] + [_case("top_n_by_rate", rank_at_most("rate", n), n) for n in range(1, max_n + 1)]


# ----------------------------------------------------------- single baselines


def last_orders_prediction(prior: DataFrame, k: int, reordered_only: bool) -> DataFrame:
    """Distinct products of the user's last ``k`` prior orders, y_hat = 1;
    with ``reordered_only`` only lines flagged as re-orders."""
    items = recent_items(prior, k)
    if reordered_only:
        items = items.where(F.col("reordered") == 1)
    return items.select("user_id", "product_id").distinct().withColumn("y_hat", F.lit(1))


def _family1(t: BasketTables, benchmark: str) -> DataFrame:
    return score_cases(family1_table(t), _only(family1_cases(), benchmark)).select(
        "user_id", *METRICS
    )


def repeat_last_order(t: BasketTables) -> DataFrame:
    """B1: predict the last prior order."""
    return _family1(t, "repeat_last_order")


def repeat_last_reorders(t: BasketTables) -> DataFrame:
    """B2: y_hat = reordered flag of the last prior order's lines."""
    return _family1(t, "repeat_last_re_order")


def repeat_last_k_reorders(t: BasketTables, k: int) -> DataFrame:
    """B3 (k=2) / B4 (k=3): re-ordered products of the last k orders."""
    return _family1(t, {2: "repeat_last_2_re_order", 3: "repeat_last_3_re_order"}[k])


def prediction_truth_full_join(t: BasketTables, k: int = 3) -> DataFrame:
    """J7 on the last-k re-order prediction: user_id, product_id, y_hat, y_act."""
    pred = last_orders_prediction(_prior_of(t, train_order_users(t)), k, True)
    return join_prediction_truth(pred, reordered_truth(t)).select(
        "user_id", "product_id", "y_hat", "y_act"
    )


def topn_baseline(t: BasketTables, max_n: int = TOP_N_MAX) -> DataFrame:
    """For each N, predict the products of dense rank <= N by times
    bought (ties kept, once-bought excluded).  Output: n, user_id, metrics."""
    return score_cases(family1_table(t, max_n), _only(family1_cases(max_n), "top_n")).select(
        "n", "user_id", *METRICS
    )


def _family2(t: BasketTables, benchmark: str) -> DataFrame:
    return score_cases(family2_table(t), _only(family2_cases(), benchmark)).select(
        "user_id", *METRICS
    )


def all_ordered_baseline(t: BasketTables) -> DataFrame:
    """Every candidate of a validation user predicted."""
    return _family2(t, "all_ordered")


def topn_by_rate_baseline(t: BasketTables, max_n: int = TOP_N_MAX) -> DataFrame:
    """Dense rank of the order rate since the first order; for each N
    predict rank <= N.  Output: n, user_id, metrics."""
    return score_cases(family2_table(t, max_n), _only(family2_cases(max_n), "top_n_by_rate")).select(
        "n", "user_id", *METRICS
    )


def last_orders_ordered_baseline(t: BasketTables, k: int) -> DataFrame:
    """B8 (k=1) / B9 (k=2): distinct products of the last k orders of
    validation users, target ordered."""
    return _family2(t, {1: "last_order", 2: "last_two_orders"}[k])


def validation_candidates(candidates: DataFrame, t: BasketTables) -> DataFrame:
    """Candidate rows of validation users (``train_ud``)."""
    return candidates.where(F.col("eval_set") == "train").join(
        validation_users(t), "user_id", "left_semi"
    )


# ---------------------------------------------------------------- leaderboard


def baseline_leaderboard(t: BasketTables) -> DataFrame:
    """Every baseline side by side: family, benchmark, n, users and the
    mean of each metric -- one metric aggregation per family."""
    parts = [
        score_cases(family1_table(t), family1_cases()).withColumn("family", F.lit("I")),
        score_cases(family2_table(t), family2_cases()).withColumn("family", F.lit("II")),
    ]
    table = reduce(DataFrame.unionByName, parts)
    return table.groupBy("family", "benchmark", "n").agg(
        F.count(F.lit(1)).alias("users"),
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
    )


__all__ = [
    "basket_metrics",
    "baseline_leaderboard",
    "family1_table",
    "family2_table",
]
