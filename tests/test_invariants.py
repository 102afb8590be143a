"""Invariants provable from the published tables and
equivalence of the single-pass rewrites with their naive forms."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.metrics import basket_metrics
from basketry.operators import baselines as B
from basketry.operators import evaluate as V
from basketry.operators import features as FE
from basketry.operators import splits as L
from basketry.operators import submit as U
from frames import rows


@pytest.fixture(scope="module")
def cands(small_tables):
    return FE.candidate_features(small_tables).cache()


def test_cp_is_the_same_for_every_family_one_baseline(small_tables):
    t = small_tables
    cps = [
        rows(df, "user_id", "cp")
        for df in (
            B.repeat_last_order(t),
            B.repeat_last_reorders(t),
            B.repeat_last_k_reorders(t, 2),
            B.repeat_last_k_reorders(t, 3),
        )
    ]
    assert all(c == cps[0] for c in cps)


def test_topn_counts_never_fall_and_ratios_are_bounded(small_tables):
    df = B.topn_baseline(small_tables).toPandas().sort_values(["user_id", "n"])
    for _, g in df.groupby("user_id"):
        assert g.tp.is_monotonic_increasing and g.pcp.is_monotonic_increasing
    assert (df.tp <= df[["cp", "pcp"]].min(axis=1)).all()
    for c in ("precision", "recall", "f1"):
        assert df[c].between(0, 1).all()
    assert ((df.f1 == 0) == (df.tp == 0)).all()


def test_last_order_not_after_user_orders(cands):
    assert cands.where(F.col("up_last_order") > F.col("user_orders")).count() == 0


def test_holdout_is_disjoint_and_covers(small_tables):
    split = L.user_holdout_split(small_tables)
    users = L.train_users(small_tables)
    assert split.count() == users.count() == split.select("user_id").distinct().count()
    parts = {r.part for r in split.select("part").distinct().collect()}
    assert parts <= {"in", "ud"}


def test_every_test_order_once_and_none_never_mixes(small_tables):
    sub = U.submission_last3_none(small_tables)
    tests = U.test_orders(small_tables)
    assert sub.count() == tests.count() == sub.select("order_id").distinct().count()
    mixed = sub.where(F.col("products").contains("None") & (F.col("products") != "None"))
    assert mixed.count() == 0


def _naive_sweep(scored: DataFrame) -> DataFrame:
    """Explode every candidate row once per cutoff (the 14x form)."""
    per_cut = []
    for c in V.cutoffs():
        lab = scored.select(
            F.lit(c).alias("cutoff"),
            "order_id",
            F.col("reordered").alias("y_act"),
            (F.col("score") > F.lit(c)).cast("int").alias("y_hat"),
        )
        m = basket_metrics(lab, key=["cutoff", "order_id"])
        per_cut.append(m)
    return reduce(DataFrame.unionByName, per_cut).groupBy("cutoff").agg(F.avg("f1").alias("mean_f1"))


def test_single_pass_cutoff_sweep_equals_naive(small_tables, cands):
    scored = B.validation_candidates(cands, small_tables).withColumn(
        "score", F.col("up_order_rate_since_first_order")
    )
    fast = {round(r.cutoff, 6): round(r.mean_f1, 9) for r in V.cutoff_sweep(scored).collect()}
    slow = {round(r.cutoff, 6): round(r.mean_f1, 9) for r in _naive_sweep(scored).collect()}
    assert fast == slow and len(fast) == 14


def test_single_pass_recency_flags_equal_self_joins(small_tables):
    p = small_tables.prior_items
    fast = rows(FE.recency_flags(p), "user_id", "product_id", *FE.FLAGS)
    last = p.groupBy("user_id").agg(F.max("order_number").alias("m"))
    pm = p.join(last, "user_id")
    keys = ["user_id", "product_id"]
    base = p.select(*keys).distinct()
    specs = [
        (FE.FLAGS[0], F.col("order_number") == F.col("m")),
        (FE.FLAGS[1], (F.col("order_number") == F.col("m")) & (F.col("reordered") == 1)),
        (FE.FLAGS[2], (F.col("order_number") == F.col("m") - 1) & (F.col("reordered") == 1)),
        (FE.FLAGS[3], (F.col("order_number") == F.col("m") - 2) & (F.col("reordered") == 1)),
    ]
    for name, cond in specs:
        side = pm.where(cond).select(*keys).distinct().withColumn(name, F.lit(1))
        base = base.join(side, keys, "left")
    base = base.na.fill(0)
    assert fast == rows(base, "user_id", "product_id", *FE.FLAGS)


def test_product_features_equal_window_form(small_tables):
    from pyspark.sql import Window

    p = small_tables.prior_items
    fast = rows(FE.product_features(FE.pair_stats(p, False)), "product_id", "prod_orders", "prod_reorder_ratio")
    w = Window.partitionBy("user_id", "product_id").orderBy("order_number")
    slow = (
        p.withColumn("pt", F.row_number().over(w))
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("prod_orders"), F.sum("reordered").alias("r"))
        .select("product_id", "prod_orders", (F.col("r") / F.col("prod_orders")).alias("prod_reorder_ratio"))
    )
    assert fast == rows(slow, "product_id", "prod_orders", "prod_reorder_ratio")
