"""Submission building.

A submission has one row per target order: ``order_id`` and ``products``,
the predicted product ids in ascending numeric order separated by spaces,
or ``None`` when nothing is predicted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.idlist import sorted_id_string
from basketry.functions.joins import join_back
from basketry.operators.history import recent_items, with_orders_back
from basketry.sources.tables import BasketTables

NONE_LABEL = "None"


def test_orders(t: BasketTables) -> DataFrame:
    return t.orders.where(F.col("eval_set") == "test").select("user_id", "order_id")


def baskets_per_order(pred: DataFrame, target_orders: DataFrame) -> DataFrame:
    """(user_id, product_id) predictions -> order_id, products string."""
    return (
        pred.join(target_orders, "user_id")
        .groupBy("order_id")
        .agg(sorted_id_string("product_id").alias("products"))
    )


def orders_without_prediction(target_orders: DataFrame, submission: DataFrame) -> DataFrame:
    """Target orders absent from a submission."""
    return target_orders.select("order_id").join(submission, "order_id", "left_anti").distinct()


def fill_none(submission: DataFrame, target_orders: DataFrame) -> DataFrame:
    """Add a ``None`` row for every target order without products, then
    order by order_id."""
    missing = orders_without_prediction(target_orders, submission).select(
        "order_id", F.lit(NONE_LABEL).alias("products")
    )
    return submission.unionByName(missing).orderBy("order_id")


def last3_reorder_pairs(prior_items: DataFrame) -> DataFrame:
    """(user_id, product_id): products re-ordered in the user's last three
    prior orders."""
    return (
        recent_items(prior_items, 3)
        .where(F.col("reordered") == 1)
        .select("user_id", "product_id")
        .distinct()
    )


def last3_reorder_baskets(prior_items: DataFrame, target_orders: DataFrame) -> DataFrame:
    """U1 for any set of target orders (user_id, order_id): re-ordered
    products of the user's last three prior orders, one string per order."""
    prior = join_back(prior_items, target_orders.select("user_id"), ["user_id"], "left_semi")
    return baskets_per_order(last3_reorder_pairs(prior), target_orders)


def submission_last3(t: BasketTables) -> DataFrame:
    """Re-ordered products of each test user's last three prior orders."""
    return last3_reorder_baskets(t.prior_items, test_orders(t))


def submission_last3_none(t: BasketTables) -> DataFrame:
    """U2 on U1."""
    return fill_none(submission_last3(t), test_orders(t))


def submission_cascade(t: BasketTables) -> DataFrame:
    """Per test order the first non-empty of
    1. re-ordered products of the last three prior orders,
    2. every product the user ever re-ordered,
    3. every product the user ever bought,
    in one pass: each (user, product) gets the best tier it satisfies, the
    user keeps the products of its best tier (the tiers are nested)."""
    orders = test_orders(t)
    prior = join_back(t.prior_items, orders.select("user_id"), ["user_id"], "left_semi")
    reo = F.col("reordered") == 1
    pairs = (
        with_orders_back(prior)
        .groupBy("user_id", "product_id")
        .agg(
            F.max(F.when((F.col("orders_back") < 3) & reo, 1).otherwise(0)).alias("t1"),
            F.max(F.when(reo, 1).otherwise(0)).alias("t2"),
        )
        .select(
            "user_id",
            "product_id",
            F.when(F.col("t1") == 1, 1).when(F.col("t2") == 1, 2).otherwise(3).alias("tier"),
        )
    )
    best = pairs.groupBy("user_id").agg(F.min("tier").alias("best"))
    pred = (
        join_back(pairs, best, ["user_id"])
        .where(F.col("tier") <= F.col("best"))
        .select("user_id", "product_id")
    )
    return baskets_per_order(pred, orders).orderBy("order_id")


def submission_from_scores(
    scored: DataFrame, target_orders: DataFrame, cutoff: float, score: str = "score"
) -> DataFrame:
    """Products with score > cutoff, ``None`` for the remaining orders."""
    pred = scored.where(F.col(score) > F.lit(cutoff)).select("user_id", "product_id")
    return fill_none(baskets_per_order(pred, target_orders), target_orders)
