"""A user holding a third of all order lines: results stay exact and the
join-back of per-user aggregates is split by AQE instead of landing in one
task."""

from __future__ import annotations

import dataclasses

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import baselines as B
from basketry.operators import features as FE
from basketry.operators import history as H
from basketry.operators import profile as E
from basketry.operators import submit as U
from basketry.sources import files
from basketry.sources.tables import materialize
from frames import make_tables

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _skewed(spark):
    orders, prior, train = [], [], []
    oid = 1
    # hot user 0: 600 prior orders of 10 lines; 300 small users: 4 orders x 3
    for user, n_orders, width in [(0, 600, 10)] + [(u, 4, 3) for u in range(1, 301)]:
        for n in range(1, n_orders + 1):
            orders.append((oid, user, "prior", n, n % 7, n % 24, None if n == 1 else 7.0))
            for j in range(width):
                product = 1 + (user * 7 + n + j) % 40
                prior.append((oid, product, j + 1, 0))
            oid += 1
        orders.append((oid, user, "train", n_orders + 1, 0, 0, 7.0))
        train.append((oid, 1 + user % 40, 1, 1))
        oid += 1
    # dedupe (order, product) and recompute reordered like the adapter does
    pdf = pd.DataFrame(prior, columns=["order_id", "product_id", "add_to_cart_order", "reordered"])
    pdf = pdf.drop_duplicates(["order_id", "product_id"])
    o = pd.DataFrame(orders, columns=["order_id", "user_id", "eval_set", "order_number", "d", "h", "s"])
    m = pdf.merge(o[["order_id", "user_id", "order_number"]], on="order_id")
    first = m.groupby(["user_id", "product_id"]).order_number.transform("min")
    pdf["reordered"] = (m.order_number > first).astype(int).values
    prior = [tuple(int(v) for v in r) for r in pdf.itertuples(index=False)]
    return make_tables(spark, orders, prior, train), m.assign(reordered=pdf["reordered"].values)


@pytest.fixture()
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_user_share_and_exact_results(skew_session):
    t, m = _skewed(skew_session)
    hot_share = (m.user_id == 0).mean()
    assert hot_share > 0.3

    got = H.last_order_items(t.prior_items.repartition(16)).select("user_id", "product_id")
    got_rows = sorted(map(tuple, got.collect()))
    last = m[m.order_number == m.groupby("user_id").order_number.transform("max")]
    assert got_rows == sorted(map(tuple, last[["user_id", "product_id"]].values.tolist()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan, plan

    # a baseline over the skewed data still has one exact row per train user
    metrics = B.repeat_last_k_reorders(t, 3).toPandas()
    assert len(metrics) == 301 and metrics.f1.between(0, 1).all()


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


JOBS = {
    "recency_flags": lambda t: FE.recency_flags(t.prior_items),
    "last3_reorder_baskets": lambda t: U.last3_reorder_baskets(
        t.prior_items, t.orders.where("eval_set = 'train'").select("user_id", "order_id")
    ),
    "prediction_truth_full_join": lambda t: B.prediction_truth_full_join(t, 3),
    "family1_table": B.family1_table,
    "family2_table": B.family2_table,
    "reorder_share_last_order": lambda t: E.reorder_share_last_order(t.prior_items),
    "reorder_share_by_hod_last_order": lambda t: E.reorder_share_by_hod_last_order(t.prior_items),
    "basket_size_by_hod_last_order": lambda t: E.basket_size_by_hod_last_order(t.prior_items),
    "submission_cascade": lambda t: U.submission_cascade(t),
}


@pytest.mark.parametrize("job", sorted(JOBS))
def test_hot_user_is_split_in_every_job(skew_session, job):
    t, _ = _skewed(skew_session)
    if job == "submission_cascade":  # needs test orders
        orders = t.orders.withColumn("eval_set", F.regexp_replace("eval_set", "train", "test"))
        t = dataclasses.replace(t, orders=orders)
    plan = _final_plan(JOBS[job](t))
    assert "skew=true" in plan, plan


def test_written_fact_needs_no_join_for_the_last_orders(skew_session):
    """The written fact carries the user's last order number."""
    t, _ = _skewed(skew_session)
    written = materialize(skew_session, t, "skew")
    try:
        assert "user_max" in written.prior_items.columns
        for job in ("recency_flags", "reorder_share_last_order", "reorder_share_by_hod_last_order"):
            df = JOBS[job](written)
            assert "Join" not in _final_plan(df), job
            assert sorted(map(tuple, df.collect())) == sorted(map(tuple, JOBS[job](t).collect()))
        train = _final_plan(written.train_items)
        assert "PartitionFilters: [isnotnull(line_file" in train and "= train)" in train
    finally:
        files.delete(skew_session, written.extras["folder"])
    assert not files.exists(skew_session, written.extras["folder"])
