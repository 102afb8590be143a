"""The query catalogue: every operator of the blueprint as a named Spark job.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the basket tables the
provider derives from the driver's tables in ``sf_dir``.  Parameters the
reference hard-codes (eval set, cutoff, k, N, bins, one user / product /
aisle to drill into) are fixed here; the library functions take them as
arguments.

Report precision: DOUBLE columns of a registered query are rounded to 6
decimals as ``floor(x * 1e6 + 0.5) / 1e6`` (values of magnitude 1e12 and
more are left as they are).  The SQL twins apply the same
arithmetic, so both engines round identically; library functions return
full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.metrics import METRICS, basket_metrics
from basketry.operators import baselines as B
from basketry.operators import dims as D
from basketry.operators import evaluate as V
from basketry.operators import features as FE
from basketry.operators import history as H
from basketry.operators import profile as E
from basketry.operators import splits as L
from basketry.operators import submit as U
from basketry.sources.tables import BasketTables, basket_tables

# Fixed drill-down parameters (present at every scale factor).
DRILL_AISLE = "Brand#13"
DRILL_PRODUCT_ID = 42
DRILL_USER_ID = 7
PLAIN_SCORE = "up_order_rate_since_first_order"
# Plain (non-model) scores compared by config_comparison.
SCORE_CONFIGS = {
    "order_rate_since_first": "up_order_rate_since_first_order",
    "order_rate": "up_order_rate",
    "product_reorder_ratio": "prod_reorder_ratio",
}

QueryFn = Callable[[SparkSession, str], DataFrame]


def round6(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 decimals (report precision)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            x = F.col(f.name)
            rounded = F.floor(x * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)
            # floor() yields BIGINT: only round where it cannot overflow
            out.append(
                F.when(F.abs(x) < F.lit(1e12), rounded).otherwise(x).cast("double").alias(f.name)
            )
        else:
            out.append(F.col(f.name))
    return df.select(out)


_REGISTRY: dict[str, QueryFn] = {}


def query(name: str, rounded: bool = True):
    def deco(fn: Callable[[BasketTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(basket_tables(spark, sf_dir))
            return round6(df) if rounded else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_REGISTRY)


# ---------------------------------------------------------- shared derivations


def candidates(t: BasketTables) -> DataFrame:
    return FE.candidate_features(t)


def scored_validation(t: BasketTables, score: str = PLAIN_SCORE) -> DataFrame:
    """Validation users' candidates with a plain score column."""
    return B.validation_candidates(candidates(t), t).withColumn("score", F.col(score))


# ---------------------------------------------------------------- sources


@query("scan_orders")
def _scan_orders(t):
    return t.orders


@query("preview_items")
def _preview_items(t):
    return D.preview_items(t, 100)


@query("filter_eval_set")
def _filter_eval_set(t):
    return D.filter_eval_set(t, "train")


@query("category_levels")
def _category_levels(t):
    return D.category_levels(t)


@query("product_dim")
def _product_dim(t):
    return D.product_dim(t)


@query("prior_items")
def _prior_items(t):
    return t.prior_items.drop("user_max")


@query("train_items")
def _train_items(t):
    return t.train_items.select("user_id", "order_id", "product_id", "reordered", "ordered")


@query("train_first_bought")
def _train_first_bought(t):
    """The first prior order with the product of each train line."""
    return H.first_bought(t.train_items, t.prior_items)


@query("train_order_items")
def _train_order_items(t):
    return D.train_order_items(t)


# ------------------------------------------------------------ history ops


@query("last_order_items")
def _last_order_items(t):
    return H.last_order_items(t.prior_items)


@query("kth_last_order_items")
def _kth_last_order_items(t):
    return H.kth_last_order_items(t.prior_items, (1, 2))


@query("semi_join_train_users")
def _semi_join_train_users(t):
    return t.prior_items.join(B.train_order_users(t), "user_id", "left_semi").select(
        "user_id", "order_id", "product_id"
    )


@query("anti_join_validation_users")
def _anti_join_validation_users(t):
    return L.anti_join_validation_users(candidates(t), t)


@query("threshold_scores")
def _threshold_scores(t):
    return V.threshold_scores(candidates(t).withColumn("score", F.col(PLAIN_SCORE)), 0.21)


@query("label_candidates")
def _label_candidates(t):
    return FE.label_candidates(FE.pair_stats(t.prior_items, with_recency=False), t.train_items)


@query("prediction_truth_full_join")
def _prediction_truth_full_join(t):
    return B.prediction_truth_full_join(t, 3)


@query("candidates_with_new_products")
def _candidates_with_new_products(t):
    return FE.candidates_with_new_products(t)


@query("orders_without_prediction")
def _orders_without_prediction(t):
    return U.orders_without_prediction(U.test_orders(t), U.submission_last3(t))


@query("distinct_reordered_products")
def _distinct_reordered_products(t):
    return E.distinct_reordered_products(t.train_items, 1)


@query("products_by_times_bought")
def _products_by_times_bought(t):
    return H.times_bought(t.prior_items).orderBy("user_id", F.col("times").desc(), "product_id")


@query("unique_products_per_user")
def _unique_products_per_user(t):
    return E.unique_products_per_user(t.prior_items)


@query("unique_products_frequency")
def _unique_products_frequency(t):
    return E.unique_products_frequency(t.prior_items)


@query("basket_size_mean_q95")
def _basket_size_mean_q95(t):
    return E.basket_size_mean_q95(t.prior_items)


@query("reorder_share_summary")
def _reorder_share_summary(t):
    return E.reorder_share_summary(t.prior_items)


@query("metric_summary")
def _metric_summary(t):
    return V.metric_summary(B.repeat_last_k_reorders(t, 3))


@query("order_share_by_dow")
def _order_share_by_dow(t):
    return E.order_share_by(t.prior_items, "order_dow")


@query("order_share_by_hod")
def _order_share_by_hod(t):
    return E.order_share_by(t.prior_items, "order_hour_of_day")


@query("product_occurrence_number")
def _product_occurrence_number(t):
    return H.product_occurrence_number(t.prior_items)


@query("dense_rank_times_bought")
def _dense_rank_times_bought(t):
    return H.dense_rank_times_bought(t.prior_items).select("user_id", "product_id", "times", "rank")


# ------------------------------------------------------------- profiles


@query("reorder_share_per_user")
def _rs_user(t):
    return E.reorder_share_per_user(t.prior_items)


@query("reorder_share_second_order")
def _rs_second(t):
    return E.reorder_share_second_order(t.prior_items)


@query("reorder_share_last_order")
def _rs_last(t):
    return E.reorder_share_last_order(t.prior_items)


@query("reorder_share_by_dow")
def _rs_dow(t):
    return E.reorder_share_by(t.prior_items, "order_dow")


@query("reorder_share_by_hod")
def _rs_hod(t):
    return E.reorder_share_by(t.prior_items, "order_hour_of_day")


@query("reorder_share_by_hod_last_order")
def _rs_hod_last(t):
    return E.reorder_share_by_hod_last_order(t.prior_items)


@query("basket_size_by_dow")
def _bs_dow(t):
    return E.basket_size_by(t.prior_items, "order_dow")


@query("basket_size_by_hod")
def _bs_hod(t):
    return E.basket_size_by(t.prior_items, "order_hour_of_day")


@query("basket_size_by_hod_last_order")
def _bs_hod_last(t):
    return E.basket_size_by_hod_last_order(t.prior_items)


@query("basket_size_per_user")
def _bs_user(t):
    return E.basket_size_per_user(t.prior_items)


@query("reorder_share_per_order")
def _rs_order(t):
    return E.reorder_share_per_order(t.prior_items)


@query("reorder_share_by_dow_se")
def _rs_dow_se(t):
    return E.reorder_share_with_se(t.prior_items, "order_dow")


@query("reorder_share_by_hod_se")
def _rs_hod_se(t):
    return E.reorder_share_with_se(t.prior_items, "order_hour_of_day")


@query("basket_size_by_dow_ci")
def _bs_dow_ci(t):
    return E.basket_size_by_dow_ci(t.prior_items, 1.96)


@query("reorder_share_histogram")
def _rs_hist(t):
    return E.reorder_share_histogram(t.prior_items, bins=100)


# What each further histogram is of, with its bins and range.
SIZE_BINS, SIZE_MAX = 100, 100.0  # basket sizes: bins of width 1
HISTOGRAMS: dict[str, tuple[Callable[[BasketTables], DataFrame], str, int, float]] = {
    "reorder_share_second_order_histogram": (
        lambda t: E.reorder_share_second_order(t.prior_items), "ave_reorder_share", 100, 1.0),
    "reorder_share_last_order_histogram": (
        lambda t: E.reorder_share_last_order(t.prior_items), "ave_reorder_share", 100, 1.0),
    "reorder_share_per_order_histogram": (
        lambda t: E.reorder_share_per_order(t.prior_items), "reorder_share", 100, 1.0),
    "basket_size_histogram": (
        lambda t: E.basket_size_per_user(t.prior_items), "ave_basket_size", SIZE_BINS, SIZE_MAX),
    "average_basket_histogram": (lambda t: candidates(t), "user_average_basket", SIZE_BINS, SIZE_MAX),
    "score_histogram": (lambda t: scored_validation(t), "score", 100, 1.0),
    "reorder_ratio_histogram": (lambda t: scored_validation(t), "user_reorder_ratio", 100, 1.0),
    "order_rate_histogram": (lambda t: scored_validation(t), "up_order_rate", 100, 1.0),
}
for _name, (_of, _col, _bins, _hi) in HISTOGRAMS.items():
    query(_name)(lambda t, of=_of, col=_col, bins=_bins, hi=_hi: E.histogram(of(t), col, bins, 0.0, hi))


@query("reorder_share_second_order_summary")
def _rs_second_summary(t):
    return E.summary_of(E.reorder_share_second_order(t.prior_items), "ave_reorder_share")


@query("reorder_share_last_order_summary")
def _rs_last_summary(t):
    return E.summary_of(E.reorder_share_last_order(t.prior_items), "ave_reorder_share")


@query("unique_products_summary")
def _unique_products_summary(t):
    return E.summary_of(E.unique_products_per_user(t.prior_items), "n_products")


@query("dataset_cardinalities")
def _cardinalities(t):
    return D.dataset_cardinalities(t)


@query("order_counts_by_eval_set")
def _order_counts(t):
    return D.order_counts_by_eval_set(t)


@query("products_in_category")
def _products_in_category(t):
    return D.products_in_category(t, DRILL_AISLE)


@query("orders_of_product")
def _orders_of_product(t):
    return D.orders_of_product(t, DRILL_PRODUCT_ID)


@query("train_products_by_reordered")
def _train_products_by_reordered(t):
    return E.train_products_by_reordered(t.train_items)


@query("always_same_basket_users")
def _always_same(t):
    return E.always_same_basket_users(t.prior_items)


@query("always_same_basket_users_exact")
def _always_same_exact(t):
    """E21 on the baskets themselves."""
    return E.always_same_basket_users_exact(t.prior_items)


@query("same_basket_train_reorder_rate")
def _same_basket_rate(t):
    return E.same_basket_train_reorder_rate(t.prior_items, D.train_order_items(t))


@query("always_reordering_orders")
def _always_reordering(t):
    return FE.always_reordering_orders(candidates(t))


@query("user_history")
def _user_history(t):
    return D.user_history(t, DRILL_USER_ID)


# ------------------------------------------------------------- features


@query("product_features")
def _product_features(t):
    return FE.product_features(FE.pair_stats(t.prior_items, with_recency=False))


@query("user_order_features")
def _user_order_features(t):
    return FE.user_order_features(t.orders)


@query("user_item_features")
def _user_item_features(t):
    return FE.user_item_features(FE.pair_stats(t.prior_items, with_recency=False))


@query("user_features")
def _user_features(t):
    return FE.user_features(t.orders, FE.pair_stats(t.prior_items, with_recency=False))


@query("target_order_context")
def _target_order_context(t):
    return FE.target_order_context(t.orders)


@query("user_product_features")
def _user_product_features(t):
    return FE.user_product_features(t.prior_items)


@query("recency_flags")
def _recency_flags(t):
    return FE.recency_flags(t.prior_items)


@query("candidate_features")
def _candidate_features(t):
    return FE.candidate_features(t, FE.written_product_features(t))


@query("candidate_features_base")
def _candidate_features_base(t):
    return FE.candidate_features_base(t, FE.written_product_features(t))


@query("candidate_split_counts")
def _candidate_split_counts(t):
    return FE.candidate_split_counts(candidates(t))


@query("user_holdout_split")
def _user_holdout_split(t):
    return L.user_holdout_split(t)


@query("row_sample")
def _row_sample(t):
    return L.row_sample(candidates(t), 0.1)


# ------------------------------------------------------------- baselines


@query("repeat_last_order")
def _b1(t):
    return B.repeat_last_order(t)


@query("repeat_last_reorders")
def _b2(t):
    return B.repeat_last_reorders(t)


@query("repeat_last_2_reorders")
def _b3(t):
    return B.repeat_last_k_reorders(t, 2)


@query("repeat_last_3_reorders")
def _b4(t):
    return B.repeat_last_k_reorders(t, 3)


@query("topn_baseline")
def _b5(t):
    return B.topn_baseline(t)


@query("all_ordered_baseline")
def _b6(t):
    return B.all_ordered_baseline(t)


@query("topn_by_rate_baseline")
def _b7(t):
    return B.topn_by_rate_baseline(t)


@query("last_order_ordered_baseline")
def _b8(t):
    return B.last_orders_ordered_baseline(t, 1)


@query("last_two_orders_baseline")
def _b9(t):
    return B.last_orders_ordered_baseline(t, 2)


@query("baseline_leaderboard")
def _b10(t):
    return B.baseline_leaderboard(t)


# ------------------------------------------------------------ evaluation


@query("user_metrics")
def _user_metrics(t):
    return basket_metrics(B.prediction_truth_full_join(t, 3), key="user_id")


@query("user_metrics_ordered")
def _user_metrics_ordered(t):
    vs = V.scores_vs_truth(scored_validation(t), B.ordered_truth(t).withColumnRenamed("y_act", "ordered"))
    return V.user_metrics_ordered(vs, 0.21)


@query("order_metrics")
def _order_metrics(t):
    return V.order_metrics(scored_validation(t), 0.21)


@query("order_metrics_unguarded")
def _order_metrics_unguarded(t):
    return V.order_metrics(scored_validation(t), 0.21, guarded=False)


@query("mean_f1")
def _mean_f1(t):
    return V.mean_f1(basket_metrics(B.prediction_truth_full_join(t, 3), key="user_id"))


@query("cutoff_sweep")
def _cutoff_sweep(t):
    return V.cutoff_sweep(scored_validation(t), key="order_id")


@query("cutoff_sweep_summary")
def _cutoff_sweep_summary(t):
    return V.cutoff_sweep_summary(scored_validation(t), key="user_id")


@query("config_comparison")
def _config_comparison(t):
    base = B.validation_candidates(candidates(t), t)
    scores = {name: F.col(col) for name, col in SCORE_CONFIGS.items()}
    return V.config_comparison(V.config_sweeps(base, scores, key="order_id"))


@query("scores_vs_truth")
def _scores_vs_truth(t):
    return V.scores_vs_truth(scored_validation(t), B.ordered_truth(t).withColumnRenamed("y_act", "ordered"))


# ------------------------------------------------------------ submissions


@query("submission_last3")
def _u1(t):
    return U.submission_last3(t)


@query("submission_last3_none")
def _u2(t):
    return U.submission_last3_none(t)


@query("submission_cascade")
def _u5(t):
    return U.submission_cascade(t)


__all__ = ["queries", "round6", "METRICS"]
