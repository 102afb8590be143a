"""Registered queries on a dataset with one customer owning about a third
of all orders, under settings that force AQE to split skewed partitions:
results must still equal the DuckDB oracle."""

from __future__ import annotations

import tempfile

import duckdb
import pytest

import __spark_entry__ as entry_mod
from parity import compare, duck_connection
from skewed_data import write_skewed
from test_skew import SKEW_CONF

QUERIES = [
    "scan_orders", "prior_items", "train_items", "last_order_items", "kth_last_order_items",
    "product_occurrence_number", "dense_rank_times_bought", "reorder_share_by_dow",
    "basket_size_by_hod_last_order", "reorder_share_summary", "basket_size_mean_q95",
    "product_features", "user_features", "recency_flags", "candidate_features",
    "repeat_last_3_reorders", "topn_baseline", "topn_by_rate_baseline", "baseline_leaderboard",
    "metric_summary", "cutoff_sweep", "scores_vs_truth", "submission_cascade",
    "always_same_basket_users", "user_holdout_split",
]


@pytest.fixture(scope="module")
def skewed(spark):
    root = write_skewed(tempfile.mkdtemp(prefix="basketry-skewed-"))
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield root, duck_connection(root)
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_customer_share(skewed):
    root, _ = skewed
    share = duckdb.sql(
        f"SELECT avg(CASE WHEN o.o_custkey = 0 THEN 1 ELSE 0 END) FROM '{root}/lineitem.parquet' l "
        f"JOIN '{root}/orders.parquet' o ON l.l_orderkey = o.o_orderkey"
    ).fetchall()[0][0]
    assert share > 0.3


@pytest.mark.parametrize("name", QUERIES)
def test_skewed_query_matches_oracle(spark, skewed, name):
    root, con = skewed
    res = compare(entry_mod.queries()[name](spark, root), con, entry_mod.oracle_sql()[name])
    assert res["ok"], res
