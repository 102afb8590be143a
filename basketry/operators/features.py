"""Product, user and user x product features and the candidate table.

Everything is derived from aggregations of prior items to
(user_id, product_id) -- ``pair_stats`` -- instead of the reference's
separate passes (a product_time window, four self-filters and four joins
for the recency flags):

* product features (F1, F2) aggregate the pairs by product; "first" and
  "second" purchases are pairs with >= 1 and >= 2 orders, which is what the
  occurrence-number window counts;
* user item features (F5) aggregate the pairs by user;
* recency flags (F10) are conditional maxima inside the pair aggregation;
* the candidate table (F14) is the pair table joined to product features
  (one row per product) and user features (one row per user).

The pair aggregation is partial on the map side, so a hot user or product
is reduced before the shuffle.  Candidate rows, product and user
features read the plain pair aggregation.  Where the lines carry their user's
last order number (the written fact), the recency flags are columns of the
candidates' own pair aggregation; else they are a second one attached by a
left join that queries not using them never compute.

Labels join the pairs on the keys they are dealt by, users come next while
the rows are narrow, and products last: from a small written table
(``written_product_features``) they are broadcast, so the pairs are dealt
twice in all, by pair and by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.joins import join_back
from basketry.functions.lineage import kept
from basketry.operators.history import with_orders_back
from basketry.sources.tables import BasketTables

FLAGS = [
    "up_ordered_one_order_ago",
    "up_re_ordered_one_order_ago",
    "up_re_ordered_two_order_ago",
    "up_re_ordered_tri_order_ago",
]

# Column order of the extended candidate table (27 model features).
CANDIDATE_COLUMNS = [
    "user_id",
    "product_id",
    "up_orders",
    "up_first_order",
    "up_last_order",
    "up_average_cart_position",
    *FLAGS,
    "prod_orders",
    "prod_reorder_probability",
    "prod_reorder_times",
    "prod_reorder_ratio",
    "user_orders",
    "user_period",
    "user_mean_days_since_prior",
    "user_mean_dow",
    "user_mean_hod",
    "user_total_products",
    "user_reorder_ratio",
    "user_distinct_products",
    "user_average_basket",
    "order_id",
    "eval_set",
    "post_days_since_last_order",
    "post_dow",
    "post_hod",
    "up_order_rate",
    "up_orders_since_last_order",
    "up_order_rate_since_first_order",
    "reordered",
]

# Column order of the base candidate table (19 model features).
BASE_CANDIDATE_COLUMNS = [
    "user_id",
    "product_id",
    "up_orders",
    "up_first_order",
    "up_last_order",
    "up_average_cart_position",
    "prod_orders",
    "prod_reorder_probability",
    "prod_reorder_times",
    "prod_reorder_ratio",
    "user_orders",
    "user_period",
    "user_mean_days_since_prior",
    "user_total_products",
    "user_reorder_ratio",
    "user_distinct_products",
    "user_average_basket",
    "order_id",
    "eval_set",
    "time_since_last_order",
    "up_order_rate",
    "up_orders_since_last_order",
    "up_order_rate_since_first_order",
    "reordered",
]

MODEL_FEATURES = [
    c
    for c in CANDIDATE_COLUMNS
    if c not in ("user_id", "product_id", "order_id", "eval_set", "reordered")
]


def _flag(cond) -> F.Column:
    return F.max(F.when(cond, 1).otherwise(0)).cast("int")


def pair_stats(prior_items: DataFrame, with_recency: bool = True) -> DataFrame:
    """One row per (user, product) bought in a prior order.

    up_orders, up_first_order, up_last_order, up_average_cart_position (F9),
    up_reorders and up_after_first (inputs of F1/F5) and, with
    ``with_recency``, the four recency flags (F10)."""
    src = with_orders_back(prior_items) if with_recency else prior_items
    aggs = [
        F.count(F.lit(1)).alias("up_orders"),
        F.min("order_number").alias("up_first_order"),
        F.max("order_number").alias("up_last_order"),
        F.avg("add_to_cart_order").alias("up_average_cart_position"),
        F.sum("reordered").cast("bigint").alias("up_reorders"),
        F.count_if(F.col("order_number") > 1).alias("up_after_first"),
    ]
    if with_recency:
        back = F.col("orders_back")
        reo = F.col("reordered") == 1
        aggs += [
            _flag(back == 0).alias(FLAGS[0]),
            _flag((back == 0) & reo).alias(FLAGS[1]),
            _flag((back == 1) & reo).alias(FLAGS[2]),
            _flag((back == 2) & reo).alias(FLAGS[3]),
        ]
    return src.groupBy("user_id", "product_id").agg(*aggs)


def user_product_features(prior_items: DataFrame) -> DataFrame:
    """user_id, product_id, up_orders, up_first_order, up_last_order,
    up_average_cart_position."""
    return pair_stats(prior_items, with_recency=False).select(
        "user_id",
        "product_id",
        "up_orders",
        "up_first_order",
        "up_last_order",
        "up_average_cart_position",
    )


def recency_flags(prior_items: DataFrame) -> DataFrame:
    """the four 0/1 recency flags per (user, product)."""
    return pair_stats(prior_items).select("user_id", "product_id", *FLAGS)


def product_features(pairs: DataFrame) -> DataFrame:
    """F1/F2 from pair stats: prod_orders and three ratios per product."""
    counts = pairs.groupBy("product_id").agg(
        F.sum("up_orders").alias("prod_orders"),
        F.sum("up_reorders").alias("prod_reorders"),
        F.count(F.lit(1)).alias("prod_first_orders"),
        F.count_if(F.col("up_orders") >= 2).alias("prod_second_orders"),
    )
    return counts.select(
        "product_id",
        "prod_orders",
        (F.col("prod_second_orders") / F.col("prod_first_orders")).alias(
            "prod_reorder_probability"
        ),
        (F.lit(1) + F.col("prod_reorders") / F.col("prod_first_orders")).alias(
            "prod_reorder_times"
        ),
        (F.col("prod_reorders") / F.col("prod_orders")).alias("prod_reorder_ratio"),
    )


def user_order_features(orders: DataFrame) -> DataFrame:
    """F3/F4 over prior orders.  A user whose prior orders carry no
    days_since_prior_order gets user_period 0 (R's sum with na.rm) and a
    NULL mean."""
    return (
        orders.where(F.col("eval_set") == "prior")
        .groupBy("user_id")
        .agg(
            F.max("order_number").alias("user_orders"),
            F.coalesce(F.sum("days_since_prior_order"), F.lit(0.0)).alias("user_period"),
            F.avg("days_since_prior_order").alias("user_mean_days_since_prior"),
            F.avg("order_dow").alias("user_mean_dow"),
            F.avg("order_hour_of_day").alias("user_mean_hod"),
        )
    )


def user_item_features(pairs: DataFrame) -> DataFrame:
    """F5 from pair stats: total items, reorder ratio (NULL when the user has
    no order after the first), distinct products."""
    return pairs.groupBy("user_id").agg(
        F.sum("up_orders").alias("user_total_products"),
        F.try_divide(F.sum("up_reorders"), F.sum("up_after_first")).alias("user_reorder_ratio"),
        F.count(F.lit(1)).alias("user_distinct_products"),
    )


def target_order_context(orders: DataFrame, extended: bool = True) -> DataFrame:
    """Each user's one non-prior order."""
    target = orders.where(F.col("eval_set") != "prior")
    if not extended:
        return target.select(
            "user_id",
            "order_id",
            "eval_set",
            F.col("days_since_prior_order").alias("time_since_last_order"),
        )
    return target.select(
        "user_id",
        "order_id",
        "eval_set",
        F.col("days_since_prior_order").alias("post_days_since_last_order"),
        F.col("order_dow").alias("post_dow"),
        F.col("order_hour_of_day").alias("post_hod"),
    )


def user_features(orders: DataFrame, pairs: DataFrame, extended: bool = True) -> DataFrame:
    """order and item features, average basket, target order context.

    Every user with prior orders has item features and one target order,
    so left joins on the (unique) user key equal inner joins here; written
    as left joins, Catalyst drops a side whose columns a query does not
    use."""
    order_f = user_order_features(orders)
    if not extended:
        order_f = order_f.drop("user_mean_dow", "user_mean_hod")
    return (
        order_f.join(user_item_features(pairs), "user_id", "left")
        .withColumn(
            "user_average_basket", F.col("user_total_products") / F.col("user_orders")
        )
        .join(target_order_context(orders, extended), "user_id")
    )


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "up_order_rate": F.col("up_orders") / F.col("user_orders"),
            "up_orders_since_last_order": F.col("user_orders") - F.col("up_last_order"),
            "up_order_rate_since_first_order": F.col("up_orders")
            / (F.col("user_orders") - F.col("up_first_order") + 1),
        }
    )


def label_candidates(pairs: DataFrame, train_items: DataFrame) -> DataFrame:
    """reordered flag of the user's train order, 0 when absent."""
    labels = train_items.select("user_id", "product_id", "reordered")
    return pairs.select("user_id", "product_id").join(
        labels, ["user_id", "product_id"], "left"
    ).select("user_id", "product_id", F.coalesce("reordered", F.lit(0)).alias("reordered"))


def written_product_features(t: BasketTables) -> DataFrame:
    """``product_features`` of all prior items, computed once and kept with the
    tables: its size is known when a join with it is planned."""
    if "product_features" not in t.extras:
        t.extras["product_features"] = kept(product_features(pair_stats(t.prior_items, with_recency=False)))
    return t.extras["product_features"]


def candidate_features(t: BasketTables, products: DataFrame | None = None) -> DataFrame:
    """the extended model table, one row per (user, previously bought
    product), 27 features, label filled with 0, log transforms applied
    (ln of a zero user_period is NULL).  ``products``: the product features,
    by default derived within the same plan."""
    prior = t.prior_items
    plain = pair_stats(prior, with_recency=False)
    labels = t.train_items.select("user_id", "product_id", "reordered")
    # Every candidate pair has recency flags and its product has product
    # features (both come from the same prior items), so these left joins
    # equal inner ones -- and Catalyst drops them from queries that do not
    # use their columns (e.g. sweeps over a plain score).
    if "user_max" in prior.columns:
        pairs = pair_stats(prior)
    else:
        pairs = plain.join(recency_flags(prior), ["user_id", "product_id"], "left")
    data = (
        pairs.join(labels, ["user_id", "product_id"], "left")
        .join(user_features(t.orders, plain), "user_id")
        .transform(_rates)
        # one row per product: broadcast by Spark if its measured size
        # allows, else a hot product is split
        .transform(lambda d: join_back(d, product_features(plain) if products is None else products, ["product_id"], "left"))
        .withColumn("reordered", F.coalesce("reordered", F.lit(0)))
        .withColumn("prod_orders", F.ln("prod_orders"))
        .withColumn("user_period", F.ln("user_period"))
    )
    return data.select(CANDIDATE_COLUMNS)


def candidate_features_base(t: BasketTables, products: DataFrame | None = None) -> DataFrame:
    """the base table (19 features, no flags, no logs); the label stays
    NULL for products missing from the train order, as in the reference."""
    pairs = pair_stats(t.prior_items, with_recency=False)
    labels = t.train_items.select("user_id", "product_id", "reordered")
    data = (
        pairs.join(labels, ["user_id", "product_id"], "left")
        .join(user_features(t.orders, pairs, extended=False), "user_id")
        .transform(_rates)
        .transform(lambda d: join_back(d, product_features(pairs) if products is None else products, ["product_id"], "left"))
    )
    return data.select(BASE_CANDIDATE_COLUMNS)


def candidates_with_new_products(t: BasketTables) -> DataFrame:
    """Candidate pairs full-joined with train items, so products bought
    for the first time in the train order also appear (flags 0 if absent)."""
    pairs = t.prior_items.select("user_id", "product_id").distinct()
    train = t.train_items.select("user_id", "product_id", "reordered", "ordered")
    return pairs.join(train, ["user_id", "product_id"], "full").select(
        "user_id",
        "product_id",
        F.coalesce("reordered", F.lit(0)).alias("reordered"),
        F.coalesce("ordered", F.lit(0)).alias("ordered"),
    )


def always_reordering_orders(candidates: DataFrame) -> DataFrame:
    """Target orders whose candidates were all bought in every prior
    order (mean up_order_rate == 1)."""
    return (
        candidates.groupBy("order_id")
        .agg(F.avg("up_order_rate").alias("mean_up_order_rate"))
        .where(F.col("mean_up_order_rate") == 1)
    )


def candidate_split_counts(candidates: DataFrame) -> DataFrame:
    """L1: candidates and users per evaluation set."""
    return candidates.groupBy("eval_set").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("user_id").alias("users")
    )
