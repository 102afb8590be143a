"""Exploratory profiles of prior orders.

All are groupBy chains over ``prior_items``.  A basket is one
(user_id, order_number) group; its weekday and hour are constant within the
basket and travel as grouping keys.  Two-level statistics (a mean of
per-user means) are two chained aggregations, each partial on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.joins import join_back
from basketry.functions.quantiles import exact_quantiles
from basketry.functions.stats import right_closed_bin, six_number_summary, standard_error
from basketry.operators.history import recent_items

BASKET = ["user_id", "order_number"]


# --------------------------------------------------------------- reorder share


def reorder_share_per_user(prior_items: DataFrame) -> DataFrame:
    """Mean reordered flag per user over orders after the first."""
    return (
        prior_items.where(F.col("order_number") > 1)
        .groupBy("user_id")
        .agg(F.avg("reordered").alias("ave_reorder_share"))
    )


def reorder_share_second_order(prior_items: DataFrame) -> DataFrame:
    """Same, in each user's second order only."""
    return (
        prior_items.where(F.col("order_number") == 2)
        .groupBy("user_id")
        .agg(F.avg("reordered").alias("ave_reorder_share"))
    )


def reorder_share_last_order(prior_items: DataFrame) -> DataFrame:
    """Same, in each user's last prior order (E3; no order_number filter)."""
    return (
        recent_items(prior_items, 1)
        .groupBy("user_id")
        .agg(F.avg("reordered").alias("ave_reorder_share"))
    )


def _share_by(items: DataFrame, bucket: str) -> DataFrame:
    """Mean over users of the per-(user, bucket) reorder share."""
    return (
        items.groupBy("user_id", bucket)
        .agg(F.avg("reordered").alias("share"))
        .groupBy(bucket)
        .agg(
            F.avg("share").alias("ave_reorder_share"),
            standard_error("share").alias("se"),
        )
    )


def reorder_share_by(prior_items: DataFrame, bucket: str) -> DataFrame:
    """E4 (bucket = order_dow) and E5 (order_hour_of_day)."""
    return _share_by(prior_items.where(F.col("order_number") > 1), bucket).select(
        bucket, "ave_reorder_share"
    )


def reorder_share_by_hod_last_order(prior_items: DataFrame) -> DataFrame:
    """Last prior order only, without the order_number > 1 filter."""
    return _share_by(recent_items(prior_items, 1), "order_hour_of_day").select(
        "order_hour_of_day", "ave_reorder_share"
    )


def reorder_share_with_se(prior_items: DataFrame, bucket: str) -> DataFrame:
    """Mean share and its standard error over users."""
    return _share_by(prior_items.where(F.col("order_number") > 1), bucket).select(
        bucket, F.col("ave_reorder_share").alias("mean"), "se"
    )


def reorder_share_per_order(prior_items: DataFrame) -> DataFrame:
    """Reorder share of each basket after the first."""
    return (
        prior_items.where(F.col("order_number") > 1)
        .groupBy("user_id", "order_number")
        .agg(F.avg("reordered").alias("reorder_share"))
    )


def histogram(values: DataFrame, col: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Histogram of a column (E15): right-closed fixed-width bins, empty bins
    included, density = count / (n * width).  Nulls are left out; values
    beyond the ends count in the first or last bin.

    The values are reduced to per-bin counts by a partial aggregation; the
    bin grid (``bins`` rows) is then joined to them."""
    width = (hi - lo) / bins
    counts = values.where(F.col(col).isNotNull()).groupBy(
        right_closed_bin(F.col(col), lo, width, bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    grid = counts.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    # Every value lands in exactly one bin, so n is the sum over the grid:
    # a global window over ``bins`` rows.
    filled = grid.join(counts, "bin", "left").select(
        "bin", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")
    )
    n = F.sum("count").over(Window.partitionBy())
    return filled.select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(hi - lo) / F.lit(bins)).alias("lower"),
        (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / F.lit(bins)).alias("upper"),
        "count",
        F.try_divide(F.col("count"), n * F.lit(width)).alias("density"),
    )


def reorder_share_histogram(
    prior_items: DataFrame, bins: int = 100, lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """Histogram of per-user reorder shares."""
    return histogram(reorder_share_per_user(prior_items), "ave_reorder_share", bins, lo, hi)


def summary_of(values: DataFrame, col: str) -> DataFrame:
    """Six-number summary of one column (A9): stat, value."""
    return six_number_summary(values.withColumnRenamed(col, "value"), ["value"])


def reorder_share_summary(prior_items: DataFrame) -> DataFrame:
    """Six-number summary of the per-user reorder share (A9): stat, value."""
    return six_number_summary(
        reorder_share_per_user(prior_items).withColumnRenamed("ave_reorder_share", "value"),
        ["value"],
    )


# ----------------------------------------------------------------- basket size


def basket_sizes(prior_items: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per prior basket: user_id, order_number, extra keys, basket_size."""
    return prior_items.groupBy(*BASKET, *(extra or [])).agg(
        F.count(F.lit(1)).alias("basket_size")
    )


def basket_size_by(prior_items: DataFrame, bucket: str) -> DataFrame:
    """Baskets per bucket with mean, standard error, min, max."""
    return (
        basket_sizes(prior_items, [bucket])
        .groupBy(bucket)
        .agg(
            F.count(F.lit(1)).alias("obs"),
            F.avg("basket_size").alias("mean"),
            standard_error("basket_size").alias("se"),
            F.min("basket_size").alias("min"),
            F.max("basket_size").alias("max"),
        )
    )


def basket_size_by_hod_last_order(prior_items: DataFrame) -> DataFrame:
    """Mean and median basket size of last prior orders by hour."""
    return exact_quantiles(
        basket_sizes(recent_items(prior_items, 1), ["order_hour_of_day"]),
        "basket_size",
        [0.5],
        ["order_hour_of_day"],
        out_cols=["median"],
        extra_aggs=[F.avg("_v").alias("mean")],
    ).select("order_hour_of_day", "mean", "median")


def basket_size_per_user(prior_items: DataFrame) -> DataFrame:
    """Mean basket size per user."""
    return (
        basket_sizes(prior_items)
        .groupBy("user_id")
        .agg(F.avg("basket_size").alias("ave_basket_size"))
    )


def basket_size_mean_q95(prior_items: DataFrame) -> DataFrame:
    """Mean and 95% quantile of per-user mean basket size."""
    return exact_quantiles(
        basket_size_per_user(prior_items),
        "ave_basket_size",
        [0.95],
        out_cols=["q95"],
        extra_aggs=[F.avg("_v").alias("mean")],
    ).select("mean", "q95")


def basket_size_by_dow_ci(prior_items: DataFrame, z: float = 1.96) -> DataFrame:
    """The bars and error bars of basket size by weekday."""
    return basket_size_by(prior_items, "order_dow").select(
        "order_dow",
        "mean",
        (F.col("mean") - F.lit(z) * F.col("se")).alias("lower"),
        (F.col("mean") + F.lit(z) * F.col("se")).alias("upper"),
    )


def order_share_by(prior_items: DataFrame, bucket: str) -> DataFrame:
    """Baskets per bucket and their share in percent.  The window is
    global but runs over at most 24 aggregated rows."""
    counts = basket_sizes(prior_items, [bucket]).groupBy(bucket).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return counts.select(
        bucket,
        "orders",
        (F.col("orders") * F.lit(100.0) / F.sum("orders").over(Window.partitionBy())).alias("pct"),
    )


# ------------------------------------------------------------ distinct products


def unique_products_per_user(prior_items: DataFrame) -> DataFrame:
    """Distinct products per user."""
    return prior_items.groupBy("user_id").agg(F.count_distinct("product_id").alias("n_products"))


def unique_products_frequency(prior_items: DataFrame) -> DataFrame:
    """Users per number of distinct products."""
    return (
        unique_products_per_user(prior_items)
        .groupBy("n_products")
        .agg(F.count(F.lit(1)).alias("users"))
    )


def train_products_by_reordered(train_items: DataFrame) -> DataFrame:
    """Train rows and distinct products by reordered flag."""
    return train_items.groupBy("reordered").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("product_id").alias("products")
    )


def distinct_reordered_products(train_items: DataFrame, flag: int = 1) -> DataFrame:
    """Distinct train products with the given reordered flag (D3)."""
    return train_items.where(F.col("reordered") == flag).select("product_id").distinct()


# ------------------------------------------------------- same-basket customers


def _basket_shapes(prior_items: DataFrame, *more: Column) -> DataFrame:
    return prior_items.groupBy("user_id", "order_id").agg(
        F.count(F.lit(1)).alias("tpo"), F.avg("product_id").alias("pro"), *more
    )


def _shape_aggs() -> list[Column]:
    return [
        F.avg("tpo").alias("mean_tpo"),
        F.min("tpo").alias("min_tpo"),
        F.max("tpo").alias("max_tpo"),
        F.min("pro").alias("min_pro"),
        F.max("pro").alias("max_pro"),
    ]


_SHAPE_COLS = ["user_id", "mean_tpo", "min_tpo", "max_tpo", "min_pro", "max_pro"]


def always_same_basket_users(prior_items: DataFrame) -> DataFrame:
    """Users whose prior baskets all look the same.

    The reference's test compares basket size and the mean product id of
    each basket (min == max over the user's baskets); equal means can
    collide (``always_same_basket_users_exact``).  Result is sorted by mean
    basket size, descending."""
    users = _basket_shapes(prior_items).groupBy("user_id").agg(*_shape_aggs())
    cond = (F.col("max_tpo") == F.col("min_tpo")) & (F.col("min_pro") == F.col("max_pro"))
    return users.where(cond).select(*_SHAPE_COLS).orderBy(F.col("mean_tpo").desc(), "user_id")


def always_same_basket_users_exact(prior_items: DataFrame) -> DataFrame:
    """Users whose prior baskets all hold the same products, each as often.

    1. Every basket gets an order-free fingerprint of its multiset: size, sum
       and exclusive or of its products' hashes.  Users whose fingerprints
       differ are out; no basket is collected.
    2. The few candidates are verified on their items: each product must be
       in every order of the user with one multiplicity.

    Columns and order as ``always_same_basket_users``."""
    h = F.xxhash64("product_id")
    marks = [F.sum(F.pmod(h, F.lit(1 << 31))).alias("_s"), F.bit_xor(h).alias("_x")]
    same = [F.min(c) == F.max(c) for c in ("tpo", "_s", "_x")]
    alike = F.lit(True)
    for c in same:
        alike = alike & c
    users = _basket_shapes(prior_items, *marks).groupBy("user_id").agg(
        *_shape_aggs(), F.count(F.lit(1)).alias("n_orders"), alike.alias("alike")
    )
    candidates = users.where("alike").select(*_SHAPE_COLS, "n_orders")
    items = join_back(prior_items.select("user_id", "order_id", "product_id"), candidates.select("user_id"), ["user_id"], "left_semi")
    times = items.groupBy("user_id", "product_id", "order_id").agg(F.count(F.lit(1)).alias("times"))
    per_product = times.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("in_orders"), F.min("times").alias("least"), F.max("times").alias("most")
    )
    verdict = join_back(per_product, candidates.select("user_id", "n_orders"), ["user_id"]).groupBy("user_id").agg(
        F.bool_and((F.col("in_orders") == F.col("n_orders")) & (F.col("least") == F.col("most"))).alias("ok")
    )
    return (
        candidates.join(verdict.where("ok"), "user_id", "left_semi")
        .select(*_SHAPE_COLS)
        .orderBy(F.col("mean_tpo").desc(), "user_id")
    )


def same_basket_train_reorder_rate(prior_items: DataFrame, train_order_items: DataFrame) -> DataFrame:
    """How many same-basket users have a train order, and the mean
    reordered flag of those train lines."""
    users = always_same_basket_users(prior_items).select("user_id")
    return (
        train_order_items.join(users, "user_id", "left_semi")
        .agg(
            F.count_distinct("user_id").alias("users"),
            F.avg("reordered").alias("mean_reordered"),
        )
    )
