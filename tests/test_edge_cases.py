"""Hand-made edge cases (FIXTURES.md part C, SURVEY §2.0 traps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.idlist import sorted_id_string
from basketry.functions.metrics import basket_metrics
from basketry.functions.stats import six_number_summary
from basketry.operators import baselines as B
from basketry.operators import evaluate as V
from basketry.operators import features as FE
from basketry.operators import history as H
from basketry.operators import profile as E
from basketry.operators import submit as U
from frames import make_tables, rows


def test_one_prior_order_user(spark):
    t = make_tables(
        spark,
        orders=[(1, 1, "prior", 1, 0, 0, None), (2, 1, "train", 2, 1, 0, 5.0)],
        prior=[(1, 10, 1, 0), (1, 11, 2, 0)],
        train=[(2, 10, 1, 1)],
    )
    c = FE.candidate_features(t).collect()
    assert len(c) == 2
    for r in c:
        assert r["user_period"] is None  # ln(0) -> NULL, not -Inf
        assert r["user_mean_days_since_prior"] is None
        assert r["user_reorder_ratio"] is None  # 0/0 -> NULL
    uof = FE.user_order_features(t.orders).collect()[0]
    assert uof["user_period"] == 0.0  # sum with na.rm of all-NA is 0


def test_dense_rank_ties_and_once_bought_excluded(spark):
    # user 1 bought product 1 three times, 2 three times, 3 twice, 4 once
    orders = [(o, 1, "prior", o, 0, 0, None if o == 1 else 1.0) for o in range(1, 4)]
    orders.append((9, 1, "train", 4, 0, 0, 1.0))
    prior = [
        (1, 1, 1, 0), (2, 1, 1, 1), (3, 1, 1, 1),
        (1, 2, 2, 0), (2, 2, 2, 1), (3, 2, 2, 1),
        (1, 3, 3, 0), (2, 3, 3, 1),
        (3, 4, 3, 0),
    ]
    t = make_tables(spark, orders, prior, train=[(9, 1, 1, 1)])
    res = {r["n"]: r["pcp"] for r in B.topn_baseline(t, max_n=3).collect()}
    assert res == {1: 2, 2: 3, 3: 3}


def test_user_without_prediction_keeps_a_row(spark):
    z = spark.createDataFrame([(5, 1, 1, 0)], "user_id long, product_id long, y_act int, y_hat int")
    r = basket_metrics(z).collect()[0]
    assert (r.tp, r.pcp, r.precision, r.f1) == (0, 0, 0.0, 0.0)


def test_nothing_reordered(spark):
    z = spark.createDataFrame(
        [(1, 1, 0, 1), (1, 2, 0, 1)], "user_id long, product_id long, y_act int, y_hat int"
    )
    r = basket_metrics(z).collect()[0]
    assert (r.cp, r.pcp, r.recall, r.f1) == (0, 2, 0.0, 0.0)


def test_numeric_id_order(spark):
    df = spark.createDataFrame([(1, 100), (1, 9), (1, 10)], "order_id long, product_id long")
    out = df.groupBy("order_id").agg(sorted_id_string("product_id").alias("p")).collect()[0].p
    assert out == "9 10 100"


def test_score_equal_to_cutoff_is_not_predicted(spark):
    df = spark.createDataFrame([(1, 1, 0.21)], "user_id long, product_id long, score double")
    assert V.threshold_scores(df, 0.21).collect()[0].y_hat == 0


def test_single_basket_bucket_has_null_se(spark):
    t = make_tables(
        spark,
        orders=[(1, 1, "prior", 1, 3, 0, None), (2, 1, "train", 2, 0, 0, 1.0)],
        prior=[(1, 10, 1, 0), (1, 11, 2, 0)],
    )
    r = E.basket_size_by(t.prior_items, "order_dow").collect()[0]
    assert r["obs"] == 1 and r["se"] is None


def test_quantiles_interpolate_like_r(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    stats = {r.stat: r.v for r in six_number_summary(df, ["v"]).collect()}
    assert (stats["1st Qu."], stats["Median"], stats["3rd Qu."]) == (1.75, 2.5, 4.75)
    assert (stats["Min."], stats["Mean"], stats["Max."]) == (1.0, 4.0, 10.0)


def test_fallback_tiers(spark):
    # user 1: re-ordered in last 3 orders -> tier 1
    # user 2: re-ordered only long ago -> tier 2
    # user 3: never re-ordered -> tier 3
    orders, prior = [], []
    oid = 100
    for user, pattern in ((1, "recent"), (2, "old"), (3, "never")):
        for n in range(1, 6):
            orders.append((oid, user, "prior", n, 0, 0, None if n == 1 else 7.0))
            if pattern == "recent":
                prior.append((oid, 5, 1, int(n > 1)))
            elif pattern == "old":
                prior.append((oid, 6 if n <= 2 else 100 + n, 1, int(n == 2)))
            else:
                prior.append((oid, 200 - n, 1, 0))
            oid += 1
        orders.append((1000 + user, user, "test", 6, 0, 0, 7.0))
    t = make_tables(spark, orders, prior, n_products=300)
    sub = {r.order_id: r.products for r in U.submission_cascade(t).collect()}
    assert sub == {1001: "5", 1002: "6", 1003: "195 196 197 198 199"}
    # the last-3 submission leaves two orders to None
    none = {r.order_id: r.products for r in U.submission_last3_none(t).collect()}
    assert none == {1001: "5", 1002: "None", 1003: "None"}


def test_last_order_window_free_matches_window(spark, small_tables):
    from pyspark.sql import Window

    p = small_tables.prior_items
    via_join = rows(H.last_order_items(p), "user_id", "product_id")
    w = Window.partitionBy("user_id")
    via_window = rows(
        p.withColumn("m", F.max("order_number").over(w)).where(F.col("order_number") == F.col("m")),
        "user_id",
        "product_id",
    )
    assert via_join == via_window


def test_same_basket_heuristic_vs_exact(spark):
    # user 1: baskets {1, 5} and {2, 4} -- same size and same mean id, so the
    # reference's heuristic calls them "the same"; the exact test does not.
    # user 2: the same basket {3, 7} twice.
    t = make_tables(
        spark,
        orders=[
            (1, 1, "prior", 1, 0, 0, None), (2, 1, "prior", 2, 0, 0, 3.0),
            (3, 2, "prior", 1, 0, 0, None), (4, 2, "prior", 2, 0, 0, 3.0),
        ],
        prior=[(1, 1, 1, 0), (1, 5, 2, 0), (2, 2, 1, 0), (2, 4, 2, 0),
               (3, 3, 1, 0), (3, 7, 2, 0), (4, 3, 1, 1), (4, 7, 2, 1)],
    )
    heuristic = {r.user_id for r in E.always_same_basket_users(t.prior_items).collect()}
    exact = {r.user_id for r in E.always_same_basket_users_exact(t.prior_items).collect()}
    assert heuristic == {1, 2} and exact == {2}


def test_blocked_row_number_equals_window(spark, small_tables):
    from pyspark.sql import Window

    p = small_tables.prior_items
    w = Window.partitionBy("user_id", "product_id").orderBy("order_number")
    plain = rows(p.withColumn("pt", F.row_number().over(w)), "user_id", "product_id", "order_number", "pt")
    for block in (1, 2, 3, 4096):  # small blocks force many blocks per pair
        blocked = H.product_occurrence_number(p, block=block)
        assert rows(blocked, "user_id", "product_id", "order_number", "product_time") == plain


def test_blocked_row_number_tie_break(spark):
    from basketry.functions.ranking import blocked_row_number

    # order 1: line numbers repeat, ties broken by product id
    df = spark.createDataFrame(
        [(1, 5, 2), (1, 3, 2), (1, 9, 1), (1, 4, 7), (1, 1, 7), (2, 8, 1)],
        "order_id long, product_id long, first_line int",
    )
    for block in (1, 2, 4096):
        out = blocked_row_number(df, ["order_id"], "first_line", "pos", block, ["product_id"])
        got = sorted((r.order_id, r.product_id, r.pos) for r in out.collect())
        assert got == [(1, 1, 4), (1, 3, 2), (1, 4, 5), (1, 5, 3), (1, 9, 1), (2, 8, 1)]
