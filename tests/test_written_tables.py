"""Tables are written when a query first reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.ranking import blocked_row_number
from basketry.sources import files
from basketry.sources.tables import load_tables, materialize

SF_SMALL = "/root/testdata/sf0.001"


def test_orders_do_not_wait_for_the_order_lines(spark):
    lazy = load_tables(spark, SF_SMALL)
    written = materialize(spark, lazy, SF_SMALL)
    folder = written.extras["folder"]
    assert sorted(map(str, written.orders.collect())) == sorted(map(str, lazy.orders.collect()))
    assert files.exists(spark, f"{folder}/orders") and not files.exists(spark, f"{folder}/order_items")
    names = written.prior_items.columns
    assert sorted(map(str, written.prior_items.select(lazy.prior_items.columns).collect())) == sorted(map(str, lazy.prior_items.collect()))
    assert files.exists(spark, f"{folder}/order_items") and "user_max" in names
    assert written.order_items is written.order_items and written.train_items.count() == lazy.train_items.count()


def test_numbering_deals_the_rows_once(spark):
    lines = spark.range(40).selectExpr("id div 4 as g", "id as o").repartition(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = blocked_row_number(lines, ["g"], "o", out_col="n", block=3)
        assert sorted(map(tuple, got.collect())) == [(i // 4, i, i % 4 + 1) for i in range(40)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan.split("== Initial Plan ==")[0], plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_orders_come_with_their_users_last_number(spark):
    tables = load_tables(spark, SF_SMALL)
    got = tables.orders_with_last.groupBy("user_id").agg(F.min("user_max").alias("a"), F.max("user_max").alias("z"))
    last = tables.orders.where("eval_set = 'prior'").groupBy("user_id").agg(F.max("order_number").alias("m"))
    both = got.join(last, "user_id", "left")
    assert both.where("not (a <=> m) or not (z <=> m)").count() == 0 and both.count() > 0
    written = materialize(spark, tables, SF_SMALL)
    assert written.order_items.count() == tables.order_items.count()
    assert files.exists(spark, f"{written.extras['folder']}/numbered_lines")
