"""Dimension lookups, filters, previews and table-level reports.

Covers S5/S6, P6, P17, J1, J3/J4 (via the table provider), E16-E18, E24.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.sources.tables import ORDER_COLS, BasketTables


def product_dim(t: BasketTables) -> DataFrame:
    """Products with aisle and department names, ids of the two dropped.

    Aisles and departments are small; Spark broadcasts them after it has
    seen their size."""
    return (
        t.products.join(t.aisles, "aisle_id")
        .join(t.departments, "department_id")
        .select("product_id", "product_name", "aisle", "department")
    )


def category_levels(t: BasketTables) -> DataFrame:
    """Levels of every categorical column (P17): kind, level."""
    parts = [
        t.aisles.select(F.lit("aisle").alias("kind"), F.col("aisle").alias("level")),
        t.departments.select(
            F.lit("department").alias("kind"), F.col("department").alias("level")
        ),
        t.products.select(
            F.lit("product_name").alias("kind"), F.col("product_name").alias("level")
        ),
        t.orders.select(F.lit("eval_set").alias("kind"), F.col("eval_set").alias("level")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def filter_eval_set(t: BasketTables, eval_set: str = "train") -> DataFrame:
    """Orders of one evaluation set (P6); the predicate reaches the scan."""
    return t.orders.where(F.col("eval_set") == eval_set).select("user_id", "order_id")


def preview(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """First ``n`` rows in a deterministic order (S5): a top-n, not a sort
    of the whole table followed by a limit."""
    return df.orderBy(*order_cols).limit(n)


def preview_items(t: BasketTables, n: int = 100) -> DataFrame:
    cols = ["user_id", "order_id", "product_id"]
    return preview(t.prior_items.select(cols), n, cols)


def train_order_items(t: BasketTables) -> DataFrame:
    """Orders joined to train items on (order_id, user_id)."""
    items = t.train_items.select("order_id", "user_id", "product_id", "reordered")
    return t.orders.join(items, ["order_id", "user_id"]).select(
        ORDER_COLS + ["product_id", "reordered"]
    )


def order_counts_by_eval_set(t: BasketTables) -> DataFrame:
    """Orders per evaluation set."""
    return t.orders.groupBy("eval_set").agg(F.count(F.lit(1)).alias("orders"))


def dataset_cardinalities(t: BasketTables) -> DataFrame:
    """Distinct products, aisles, departments, users, orders, train users."""

    def one(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.agg(F.count_distinct(col).alias("value")).select(
            F.lit(name).alias("metric"), "value"
        )

    parts = [
        one(t.products, "product_id", "products"),
        one(t.aisles, "aisle", "aisles"),
        one(t.departments, "department", "departments"),
        one(t.orders, "user_id", "users"),
        one(t.orders, "order_id", "orders"),
        one(t.train_items, "user_id", "train_users"),
    ]
    return reduce(DataFrame.unionByName, parts)


def products_in_category(t: BasketTables, aisle: str) -> DataFrame:
    """Products of one aisle."""
    return product_dim(t).where(F.col("aisle") == aisle).select("product_id", "product_name")


def orders_of_product(t: BasketTables, product_id: int) -> DataFrame:
    """Prior order lines of one product."""
    return t.order_products_prior.where(F.col("product_id") == product_id).select(
        "order_id", "add_to_cart_order", "reordered"
    )


def user_history(t: BasketTables, user_id: int) -> DataFrame:
    """One user's prior order lines."""
    return t.prior_items.where(F.col("user_id") == user_id).select(
        "order_number", "order_id", "product_id", "reordered"
    )
