"""Hand-made basket tables for edge cases."""

from __future__ import annotations

from pyspark.sql import SparkSession

from basketry.sources import schemas
from basketry.sources.tables import BasketTables


def make_tables(
    spark: SparkSession,
    orders: list[tuple],
    prior: list[tuple],
    train: list[tuple] | None = None,
    n_products: int = 200,
) -> BasketTables:
    """orders: (order_id, user_id, eval_set, order_number, dow, hod, days)
    prior/train items: (order_id, product_id, add_to_cart_order, reordered)."""
    products = [(i, f"p{i}", 1, 1) for i in range(1, n_products + 1)]
    return BasketTables(
        orders=spark.createDataFrame(orders, schemas.ORDERS),
        order_products_prior=spark.createDataFrame(prior, schemas.ORDER_PRODUCTS),
        order_products_train=spark.createDataFrame(train or [], schemas.ORDER_PRODUCTS),
        products=spark.createDataFrame(products, schemas.PRODUCTS),
        aisles=spark.createDataFrame([(1, "a")], schemas.AISLES),
        departments=spark.createDataFrame([(1, "d")], schemas.DEPARTMENTS),
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
