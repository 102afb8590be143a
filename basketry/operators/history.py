"""Per-user order history: last orders, occurrence numbers, purchase counts.

"The user's last k prior orders" (P9, P10, T8) is computed as a per-user
aggregate joined back, not as a window: the aggregate is partial on the map
side, and a user holding a large share of rows is split across tasks by
AQE's skew-join handling, whereas a window would put all of that user's
rows in one task.  When the user table is small, AQE turns the join into a
broadcast after measuring it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.joins import first_match, first_rows, join_back
from basketry.functions.ranking import DEFAULT_BLOCK, blocked_row_number


def user_last_order(prior_items: DataFrame) -> DataFrame:
    """user_id, user_max = the number of the user's last prior order."""
    return prior_items.groupBy("user_id").agg(F.max("order_number").alias("user_max"))


def with_orders_back(prior_items: DataFrame) -> DataFrame:
    """Prior items plus ``orders_back`` (0 = last prior order, 1 = the one
    before, ...).

    Every user of ``prior_items`` has a row in its own per-user maximum, so
    the left join equals the inner join.  ``join_back`` keeps a dominant
    user splittable by AQE; callers that do not need ``orders_back`` should
    not ask for it (the join is not pruned)."""
    if "user_max" in prior_items.columns:
        # the materialised fact carries it: no join, nothing to split
        return prior_items.withColumn("orders_back", F.col("user_max") - F.col("order_number"))
    last = user_last_order(prior_items)
    return join_back(prior_items, last, ["user_id"], "left").withColumn(
        "orders_back", F.col("user_max") - F.col("order_number")
    )


def recent_items(prior_items: DataFrame, k: int) -> DataFrame:
    """Items of the user's last ``k`` prior orders (order_number >= max-k+1)."""
    return with_orders_back(prior_items).where(F.col("orders_back") < k)


def last_order_items(prior_items: DataFrame) -> DataFrame:
    """Items of each user's last prior order."""
    return recent_items(prior_items, 1).select(
        "user_id", "product_id", "order_number", "reordered"
    )


def kth_last_order_items(prior_items: DataFrame, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Items of the order k orders before the last one, per k (P10)."""
    return (
        with_orders_back(prior_items)
        .where(F.col("orders_back").isin(list(ks)))
        .select(
            F.col("orders_back").alias("k"), "user_id", "product_id", "reordered"
        )
    )


def times_bought(prior_items: DataFrame) -> DataFrame:
    """user_id, product_id, times = prior orders containing the product."""
    return prior_items.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("times")
    )


def dense_rank_times_bought(prior_items: DataFrame, min_times: int = 1) -> DataFrame:
    """Dense rank of products per user by times bought, ties kept."""
    counts = times_bought(prior_items).where(F.col("times") >= min_times)
    return dense_rank_per_user(counts, "times", "rank")


def dense_rank_per_user(rows: DataFrame, by: str, out: str) -> DataFrame:
    """``rows`` and ``out``: the dense rank of ``by`` within the user,
    largest first; a null ``by`` gets no rank.

    The window ranks the user's *distinct values* (one row each, far fewer
    than products), and the ranks are joined back, so no task holds all
    products of a user."""
    w = Window.partitionBy("user_id").orderBy(F.col(by).desc())
    values = rows.where(F.col(by).isNotNull()).select("user_id", by).distinct()
    return join_back(rows, values.withColumn(out, F.dense_rank().over(w)), ["user_id", by], "left")


def with_top_values(rows: DataFrame, by: str, n: int, prefix: str = "top_") -> DataFrame:
    """``rows`` and, of their user, the ``n`` largest distinct values of ``by``
    as columns ``top_1`` ... (NULL where there are fewer): what "dense rank of
    at most k" needs, as one small row a user.  The window keeps ``n`` rows a
    user and task."""
    w = Window.partitionBy("user_id").orderBy(F.col("_value").desc())
    values = rows.where(F.col(by).isNotNull()).select("user_id", F.col(by).alias("_value")).distinct()
    best = values.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    tops = best.groupBy("user_id").agg(
        *[F.max(F.when(F.col("_rank") == k, F.col("_value"))).alias(f"{prefix}{k}") for k in range(1, n + 1)]
    )
    return join_back(rows, tops, ["user_id"], "left")


def rank_at_most(by: str, k: int, prefix: str = "top_") -> Column:
    """Whether the dense rank of ``by`` is at most ``k``: it reaches the k-th
    largest value, or the smallest one of a user with fewer."""
    return F.col(by) >= F.coalesce(*[F.col(f"{prefix}{i}") for i in range(k, 0, -1)])


def product_occurrence_number(prior_items: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """k-th time the user buys the product, by order number.

    A (user, product) pair bought in very many orders is numbered in blocks
    of order numbers (``blocked_row_number``), so no task holds the whole
    pair."""
    return blocked_row_number(
        prior_items.select("user_id", "product_id", "order_number"),
        ["user_id", "product_id"],
        "order_number",
        out_col="product_time",
        block=block,
    ).select("user_id", "product_id", "order_number", "product_time")


def first_bought(train_items: DataFrame, prior_items: DataFrame) -> DataFrame:
    """Each train line with the first prior order of its user that had the
    product (J3 on two keys): NULL for a product bought for the first time."""
    keys = ["user_id", "product_id"]
    seen = prior_items.select(*keys, "order_number", F.col("order_id").alias("first_order_id"))
    firsts = first_rows(seen, keys, ["order_number"]).withColumnRenamed("order_number", "first_order_number")
    return first_match(train_items, firsts, keys).select("order_id", *keys, "first_order_number", "first_order_id")
