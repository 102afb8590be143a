"""The basket tables a query runs on, and where they come from.

``BasketTables`` holds the six reference tables (orders, prior and train
order items, products, aisles, departments) and derives the two fact views
every analysis starts from:

* ``prior_items``  orders joined to prior order items (J2)
* ``train_items``  train order items with their user id looked up (J3)

``basket_tables(spark, sf_dir)`` is the provider used by the query
catalogue.  By default it returns a lazy plan over the driver's parquet.
When the session names a checkpoint folder (``spark.checkpoint.dir``, the
shared folder of the cluster) the derived tables are written there once per
application (deleted at its end) and every later query scans those files: lineage is cut, a
lost executor only re-reads files, and the derivation is not repeated per
query.  ``basketry.materialize`` = "auto" (default) / "true" / "false".
See ``materialize`` for the two file layouts.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.joins import first_match, first_rows, join_back
from basketry.session import app_id, checkpoint_dir, tune_session
from basketry.sources import files
from basketry.sources.fixture import driver_basket_frames
from basketry.sources.readers import read_basket_csv, read_basket_parquet

ORDER_COLS = [
    "order_id",
    "user_id",
    "eval_set",
    "order_number",
    "order_dow",
    "order_hour_of_day",
    "days_since_prior_order",
]
ITEM_COLS = ["product_id", "add_to_cart_order", "reordered"]
#: Column of the written fact that names the file of a line: prior or train.
FILE = "line_file"


def first_orders(orders: DataFrame) -> DataFrame:
    """One row per order id: of orders that share an id the first by user and
    number."""
    return first_rows(orders, ["order_id"], ["user_id", "order_number"])


@dataclass
class BasketTables:
    orders: DataFrame
    order_products_prior: DataFrame
    order_products_train: DataFrame
    products: DataFrame
    aisles: DataFrame
    departments: DataFrame
    # Optional denormalised fact: every order line with its order columns.
    order_items: DataFrame | None = None
    # How to make that fact from a copy of the orders; the second argument
    # writes a table that is read twice.
    items_of: Callable[..., DataFrame] | None = None
    # The orders with ``user_max``, where they come with it.
    orders_with_last: DataFrame | None = None
    # What belongs to these tables and goes with them (models, say).
    extras: dict = field(default_factory=dict)

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame]) -> "BasketTables":
        return cls(
            orders=frames["orders"],
            order_products_prior=frames["order_products_prior"],
            order_products_train=frames["order_products_train"],
            products=frames["products"],
            aisles=frames["aisles"],
            departments=frames["departments"],
            order_items=frames.get("order_items"),
            items_of=frames.get("items_of"),
            orders_with_last=frames.get("orders_with_last"),
        )

    @property
    def prior_items(self) -> DataFrame:
        """``orderp_products``: all order columns plus the item columns, and
        ``user_max`` (the user's last prior order number) where the fact has
        it.  Lines of unknown orders have no order to join and drop out; a
        repeated order id gives a row for each of its orders."""
        if self.order_items is not None:
            more = [c for c in self.order_items.columns if c == "user_max"]
            lines = FILE if FILE in self.order_items.columns else "eval_set"
            return self.order_items.where(F.col(lines) == "prior").select(
                ORDER_COLS + ITEM_COLS + more
            )
        return self.orders.join(self.order_products_prior, "order_id").select(
            ORDER_COLS + ITEM_COLS
        )

    @property
    def train_items(self) -> DataFrame:
        """Train order items with user_id looked up and ``ordered = 1``.

        The lookup takes the first match and NULL if there is none, as
        ``match`` does: a left join on one row per order id (``first_orders``),
        so every line of the train file comes out exactly once.
        """
        return (
            first_match(self.order_products_train, first_orders(self.orders.select("order_id", "user_id", "order_number")), ["order_id"])
            .select(
                "user_id",
                "order_id",
                "product_id",
                "add_to_cart_order",
                "reordered",
                F.lit(1).alias("ordered"),
            )
        )


class WrittenTables(BasketTables):
    """Basket tables that are written at their first use: a query that reads
    orders does not wait for the order lines.  ``makers``: how each table is
    made, by name."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], extras: dict):
        self._makers, self._made, self._lock = makers, {}, threading.RLock()
        self.extras, self.items_of, self.orders_with_last = extras, None, None

    def _table(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._made:
                self._made[name] = self._makers[name]()
            return self._made[name]

    orders = property(lambda self: self._table("orders"))
    order_products_prior = property(lambda self: self._table("order_products_prior"))
    order_products_train = property(lambda self: self._table("order_products_train"))
    products = property(lambda self: self._table("products"))
    aisles = property(lambda self: self._table("aisles"))
    departments = property(lambda self: self._table("departments"))
    order_items = property(lambda self: self._table("order_items"))
    train_items = property(lambda self: self._table("train_items"))


# ---------------------------------------------------------------- provider

_MEMO: dict[tuple, BasketTables] = {}


def _session_key(spark: SparkSession, sf_dir: str) -> tuple:
    return (app_id(spark), sf_dir, files.content_key(spark, sf_dir))


def source_kind(data_dir: str, spark: SparkSession | None = None) -> str:
    """What a data folder holds: the reference's six CSV files ("csv"), the
    same six tables as parquet folders ("parquet"), or the driver's
    TPC-H-like tables ("driver").  The folder's own file system is asked."""
    spark = spark or SparkSession.getActiveSession()
    if files.exists(spark, f"{data_dir}/orders.csv"):
        return "csv"
    if files.exists(spark, f"{data_dir}/orders") and files.exists(spark, f"{data_dir}/order_products_prior"):
        return "parquet"
    return "driver"


def load_tables(spark: SparkSession, data_dir: str) -> BasketTables:
    kind = source_kind(data_dir, spark)
    if kind == "csv":
        return BasketTables.from_frames(read_basket_csv(spark, data_dir))
    if kind == "parquet":
        return BasketTables.from_frames(read_basket_parquet(spark, data_dir))
    return BasketTables.from_frames(driver_basket_frames(spark, data_dir))


def basket_tables(spark: SparkSession, sf_dir: str) -> BasketTables:
    """Basket tables for the data in ``sf_dir`` (memoised per session, for as
    long as the folder's files stay as they are).

    ``sf_dir`` may hold the reference's CSV inputs, basket parquet tables
    or the driver's tables (see ``source_kind``)."""
    key = _session_key(spark, sf_dir)
    if key in _MEMO:
        return _MEMO[key]
    tune_session(spark)
    tables = load_tables(spark, sf_dir)
    if should_materialize(spark):
        tables = materialize(spark, tables, sf_dir)
    _MEMO[key] = tables
    return tables


def checkpoint_base(spark: SparkSession) -> str | None:
    return checkpoint_dir(spark)


def should_materialize(spark: SparkSession) -> bool:
    """``basketry.materialize``: "true", "false" or "auto" (default) -- write
    the derived tables once whenever the session names a checkpoint folder."""
    mode = spark.conf.get("basketry.materialize", "auto").lower()
    if mode == "auto":
        return checkpoint_base(spark) is not None
    return mode == "true"


def forget(spark: SparkSession | None = None) -> None:
    """Drop memoised tables (all, or those of one session), and the models
    kept with them.  Their files stay until the application ends, as other
    DataFrames may still read them."""
    for key in list(_MEMO):
        if spark is None or key[0] == app_id(spark):
            del _MEMO[key]


def materialize(spark: SparkSession, tables: BasketTables, tag: str) -> BasketTables:
    """Write the basket tables once under the checkpoint folder and read back,
    each when it is first asked for (``WrittenTables``).

    Two layouts (``basketry.layout``):

    The fact has a column ``line_file``: train lines are those of the train
    file, each once with its first order (NULLs if it is unknown), prior lines
    those of the prior file with an order, as in the lazy plan.

    * ``clustered`` (default): facts and orders range-partitioned on
      (user_id, order_number, order_id) and sorted inside each file.  Range
      partitioning on the composite key splits a user holding a large
      share of rows over several files, reads stay split-parallel, row-group
      min/max statistics on user_id let point and range filters skip data,
      and per-user aggregates are partial before their (small) shuffle.
    * ``bucketed``: facts and orders bucketed by user_id (``basketry.buckets``
      buckets, default the shuffle partition count), so user-keyed
      aggregates and joins need no exchange at all.  A bucket is read by one
      task, so this layout is only for data without a dominant user.
    """
    base = checkpoint_base(spark)
    if not base:
        # No shared folder is configured: stay lazy rather than write to a
        # machine-local path.
        return tables
    # a fresh folder per materialisation: nothing that an existing DataFrame
    # (of this or another application) reads is ever overwritten
    app = app_id(spark).replace("/", "_")
    root = os.path.join(base.replace("file:", ""), f"basket-tables-{app}-{uuid.uuid4().hex[:12]}")
    files.delete_at_end(spark, root)
    layout = spark.conf.get("basketry.layout", "clustered")
    parts = int(spark.conf.get("basketry.buckets", spark.conf.get("spark.sql.shuffle.partitions")))
    prefix = "basketry_" + os.path.basename(root).replace("-", "_")

    def save_fact(df: DataFrame, name: str, split_by: list[str]) -> DataFrame:
        path = os.path.join(root, name)
        # the order id deals the lines of unknown orders, which have no user
        keys = ["user_id", "order_number", "order_id"]
        if layout == "bucketed":
            table = f"{prefix}_{name}"
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            writer = df.write.mode("overwrite").bucketBy(parts, "user_id").sortBy(*keys)
            if split_by:
                writer = writer.partitionBy(*split_by)
            writer.option("path", path).saveAsTable(table)
            return spark.table(table)
        writer = df.repartitionByRange(parts, *keys).sortWithinPartitions(*split_by, *keys).write
        if split_by:
            writer = writer.partitionBy(*split_by)
        writer.mode("errorifexists").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def save_plain(df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(root, name)
        df.write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)

    last = (
        tables.orders.where(F.col("eval_set") == "prior")
        .groupBy("user_id")
        .agg(F.max("order_number").alias("user_max"))
    )

    def orders() -> DataFrame:
        found = tables.orders_with_last
        if found is None:
            found = join_back(tables.orders, last, ["user_id"], "left")
        return save_fact(found, "orders", [])

    def order_items() -> DataFrame:
        written = out._table("orders_with_last")
        if tables.items_of is not None:
            # Lines derived from their orders: each has one, and its file follows.
            items_all = tables.items_of(written, lambda df: save_plain(df, "numbered_lines")).withColumn(FILE, F.col("eval_set"))
        else:
            # The file of a line decides what it is, whatever its order says.
            prior = written.join(tables.order_products_prior, "order_id").withColumn(FILE, F.lit("prior"))
            train = first_match(tables.order_products_train, first_orders(written), ["order_id"]).withColumn(FILE, F.lit("train"))
            items_all = prior.unionByName(train)
        return save_fact(items_all.select(ORDER_COLS + ITEM_COLS + ["user_max", FILE]), "order_items", [FILE])

    def lines(name: str) -> DataFrame:
        return out.order_items.where(F.col(FILE) == name)

    def order_products_prior() -> DataFrame:
        # as read, with lines of unknown orders; derived lines all have one
        if tables.items_of is None:
            return tables.order_products_prior
        return lines("prior").select("order_id", *ITEM_COLS)

    def train_items() -> DataFrame:
        return lines("train").select(
            "user_id",
            "order_id",
            "product_id",
            "add_to_cart_order",
            "reordered",
            F.lit(1).alias("ordered"),
        )

    out = WrittenTables(
        {
            "orders_with_last": orders,
            "orders": lambda: out._table("orders_with_last").select(ORDER_COLS),
            "order_items": order_items,
            "order_products_prior": order_products_prior,
            "order_products_train": lambda: lines("train").select("order_id", *ITEM_COLS),
            "train_items": train_items,
            "products": lambda: save_plain(tables.products, "products"),
            "aisles": lambda: save_plain(tables.aisles, "aisles"),
            "departments": lambda: save_plain(tables.departments, "departments"),
        },
        {"folder": root},
    )
    return out
