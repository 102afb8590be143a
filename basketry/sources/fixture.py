"""Fixture adapter: the driver's TPC-H-like tables -> the six basket tables.

Mapping (see FIXTURES.md, part B):

* product     = one distinct (p_brand, p_type) pair, ids numbered by name
* aisle       = p_brand, department = p_type
* user        = o_custkey, order = o_orderkey (only orders with a line)
* order items = lines grouped by (order, product); cart position by the
                smallest line number, ties broken by product id
* the last order of a user is its target order (train when
  user_id % 11 < 7, else test); all earlier ones are prior
* reordered   = the user bought the product in an earlier order

Plan shape: line items are grouped to (order, product); cart positions are
numbered in blocks of line numbers; the join to orders is on order id.  The
reorder flag is a per-(user, product) minimum joined back.  No window spans all rows of a user: order numbers
are built from per-(user, timestamp) pieces (see ``_orders``).  The ids of the
product dimension are dense numbers by range partition and offsets
(``dense_numbers``), so no window spans the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.joins import join_back
from basketry.functions.numbering import dense_numbers
from basketry.functions.ranking import blocked_row_number
from basketry.sources.readers import read_driver_table

# Fixed values of the fixture rules (FIXTURES.md part B).
TRAIN_MODULUS = 11  # user_id % 11 ...
TRAIN_BELOW = 7  # ... < 7 -> train, else test
HOURS_PER_DAY = 24  # order_hour_of_day = order_id % 24


def _catalogue(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """products, aisles, departments and the part -> product map; ids are
    dense numbers by name, from 1."""

    def one_based(df: DataFrame, order: list[str], column: str, kind: str) -> DataFrame:
        numbered = dense_numbers(df, order, number=column)
        return numbered.withColumn(column, (F.col(column) + 1).cast(kind))

    pairs = part.select("p_brand", "p_type").distinct()
    named = one_based(pairs, ["p_brand", "p_type"], "product_id", "bigint").select(
        "product_id",
        F.concat_ws(" ", "p_brand", "p_type").alias("product_name"),
        F.col("p_brand").alias("aisle"),
        F.col("p_type").alias("department"),
    )
    aisles = one_based(part.select(F.col("p_brand").alias("aisle")).distinct(), ["aisle"], "aisle_id", "int")
    departments = one_based(
        part.select(F.col("p_type").alias("department")).distinct(), ["department"], "department_id", "int"
    )
    products = (
        named.join(aisles, "aisle")
        .join(departments, "department")
        .select("product_id", "product_name", "aisle_id", "department_id")
    )
    part_map = part.join(
        named.select(
            "product_id",
            F.col("aisle").alias("p_brand"),
            F.col("department").alias("p_type"),
        ),
        ["p_brand", "p_type"],
    ).select("p_partkey", "product_id")
    return products, aisles.select("aisle_id", "aisle"), departments.select("department_id", "department"), part_map


def _orders(orders_raw: DataFrame, lines: DataFrame) -> DataFrame:
    """Basket orders: numbered per user by (o_orderdate, o_orderkey), target
    order flagged, with the user's last prior order number (``user_max``, null
    if there is none).

    A per-user window over all of a user's orders would put a user holding
    a large share of orders into one task.  Instead the number is
    assembled from bounded pieces:

    * orders per (user, timestamp) -- a partial aggregation of the numbers
      inside each group;
    * per user, a running count over its distinct order timestamps, plus
      the previous timestamp and the user's total (one row per distinct
      timestamp: bounded by the calendar for date-valued order dates);
    * inside one (user, timestamp) group the order is by order id alone, so
      it is numbered in blocks of order ids (``blocked_row_number``).

    order_number = orders at earlier timestamps + number within the group.
    """
    kept = orders_raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
    ).join(lines.select(F.col("l_orderkey").alias("order_id")), "order_id", "left_semi")

    in_ts = blocked_row_number(kept, ["user_id", "ts"], "order_id", out_col="rn_ts")
    user_ts = Window.partitionBy("user_id").orderBy("ts")
    per_ts = (
        # counted as the last number inside: reads the shuffles of the numbers
        in_ts.groupBy("user_id", "ts")
        .agg(F.max("rn_ts").alias("n_ts"))
        .select(
            "user_id",
            "ts",
            F.coalesce(
                F.sum("n_ts").over(user_ts.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("before"),
            F.lag("ts").over(user_ts).alias("prev_ts"),
            F.sum("n_ts").over(Window.partitionBy("user_id")).alias("n_orders"),
        )
    )
    numbered = (
        in_ts.join(per_ts, ["user_id", "ts"])
        .select(
            "order_id",
            "user_id",
            "ts",
            (F.col("before") + F.col("rn_ts")).cast("int").alias("order_number"),
            # an earlier order at the same timestamp, else the previous timestamp
            F.when(F.col("rn_ts") > 1, F.col("ts")).otherwise(F.col("prev_ts")).alias("prev"),
            "n_orders",
        )
    )
    return numbered.select(
        "order_id",
        "user_id",
        F.when(F.col("order_number") < F.col("n_orders"), F.lit("prior"))
        .when(F.col("user_id") % TRAIN_MODULUS < TRAIN_BELOW, F.lit("train"))
        .otherwise(F.lit("test"))
        .alias("eval_set"),
        "order_number",
        (F.dayofweek("ts") - 1).alias("order_dow"),
        (F.col("order_id") % HOURS_PER_DAY).cast("int").alias("order_hour_of_day"),
        F.datediff(F.to_date("ts"), F.to_date("prev")).cast("double").alias("days_since_prior_order"),
        # the number of the user's last prior order: all but the target order are
        F.when(F.col("n_orders") > 1, F.col("n_orders") - 1).cast("int").alias("user_max"),
    )


def _order_items(items: DataFrame) -> DataFrame:
    """Order lines with their order columns, and whether the user bought the
    product in an earlier order.  The first order number of each (user,
    product) is a partial aggregation joined back (AQE splits a dominant
    pair), not a window over all its lines."""
    firsts = items.groupBy("user_id", "product_id").agg(
        F.min("order_number").alias("first_number")
    )
    return (
        join_back(items, firsts, ["user_id", "product_id"])
        .withColumn("reordered", (F.col("order_number") > F.col("first_number")).cast("int"))
        .select(
            "order_id",
            "user_id",
            "eval_set",
            "order_number",
            "order_dow",
            "order_hour_of_day",
            "days_since_prior_order",
            "product_id",
            "add_to_cart_order",
            "reordered",
            *[c for c in items.columns if c == "user_max"],
        )
    )


def driver_basket_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | Callable[..., DataFrame]]:
    """All basket tables, lazily, from the driver's parquet files.

    Returns the six reference tables plus ``order_items``: every order line
    (prior and target orders) joined to its order columns, which is the
    denormalised fact the prior/train tables are cut from, ``items_of``,
    which makes it from any copy of the orders, and ``orders_with_last``, the
    orders with ``user_max``.
    """
    part = read_driver_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lineitem = read_driver_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber"
    )
    orders_raw = read_driver_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )

    products, aisles, departments, part_map = _catalogue(part)
    orders_with_last = _orders(orders_raw, lineitem)
    orders = orders_with_last.drop("user_max")

    lines = (
        lineitem.join(part_map, lineitem.l_partkey == part_map.p_partkey)
        .groupBy(F.col("l_orderkey").alias("order_id"), "product_id")
        .agg(F.min("l_linenumber").alias("first_line"))
    )
    # cart position: numbered in blocks of line numbers, so even an order
    # with a huge number of lines is not one task
    numbered = blocked_row_number(
        lines, ["order_id"], "first_line", out_col="add_to_cart_order", tie_break=["product_id"]
    )

    def items_of(orders: DataFrame, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The fact for any copy of the orders (the written one, say); a
        ``user_max`` column of theirs comes along.  The numbered lines are
        read twice: ``save`` can write them once."""
        return _order_items(save(numbered.join(orders, "order_id")))

    order_items = items_of(orders)
    item_cols = ["order_id", "product_id", "add_to_cart_order", "reordered"]
    return {
        "orders": orders,
        "orders_with_last": orders_with_last,
        "products": products,
        "aisles": aisles,
        "departments": departments,
        "order_items": order_items,
        "items_of": items_of,
        "order_products_prior": order_items.where(F.col("eval_set") == "prior").select(item_cols),
        "order_products_train": order_items.where(F.col("eval_set") == "train").select(item_cols),
    }
