"""First-match lookups: lazy and written tables agree on unknown and repeated orders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.functions.joins import first_match, first_rows
from basketry.functions.numbering import dense_numbers, running_sums
from basketry.operators import dims as D
from basketry.sources.tables import materialize
from frames import make_tables, rows

ORDERS = [
    (1, 1, "prior", 1, 0, 0, None), (2, 1, "train", 2, 0, 0, 3.0),
    (3, 2, "prior", 1, 0, 0, None), (4, 2, "train", 2, 0, 0, 3.0),
    # order 4 is there twice, and again for another user
    (4, 2, "train", 2, 0, 0, 3.0), (4, 1, "train", 9, 0, 0, 3.0),
    # a prior order with lines in the train file
    (5, 3, "prior", 1, 0, 0, None),
]
PRIOR = [(1, 10, 1, 0), (3, 11, 1, 0), (3, 11, 2, 0), (88, 12, 1, 0)]
TRAIN = [(2, 10, 1, 1), (4, 11, 1, 1), (4, 11, 1, 1), (5, 12, 1, 0), (99, 13, 1, 0), (98, 13, 2, 1)]
WANT = [(1, 2, 10), (1, 4, 11), (1, 4, 11), (3, 5, 12), (None, 98, 13), (None, 99, 13)]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("layout", ["clustered", "bucketed"])
def test_train_lines_keep_unknown_orders_and_take_the_first(spark, layout):
    lazy = make_tables(spark, ORDERS, PRIOR, TRAIN)
    spark.conf.set("basketry.layout", layout)
    try:
        written = materialize(spark, lazy, "lookup")
    finally:
        spark.conf.unset("basketry.layout")
    cols = ["user_id", "order_id", "product_id"]
    for t in (lazy, written):
        assert key(tuple(r) for r in t.train_items.select(cols).collect()) == key(WANT)
        assert t.train_items.agg(F.min("ordered")).first()[0] == 1
    for part in ("order_products_prior", "order_products_train"):
        names = ["order_id", "product_id", "add_to_cart_order", "reordered"]
        assert rows(getattr(written, part), *names) == rows(getattr(lazy, part), *names)
    names = ["user_id", "order_id", "eval_set", "product_id", "add_to_cart_order"]
    assert rows(written.prior_items, *names) == rows(lazy.prior_items, *names)
    assert rows(D.train_order_items(written), "order_id", "user_id", "product_id") == rows(D.train_order_items(lazy), "order_id", "user_id", "product_id")


def test_first_match_on_several_keys(spark):
    table = spark.createDataFrame([(1, "a", 5, "x"), (1, "a", 3, "z"), (1, "a", 3, "y"), (2, "a", 1, "w"), (None, "a", 1, "n")], "k long, g string, at int, v string")
    firsts = first_rows(table, ["k", "g"], ["at"])
    assert firsts.columns == table.columns and firsts.count() == 3
    lines = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (2, "a")], "k long, g string")
    got = first_match(lines, firsts, ["k", "g"])
    assert got.columns == ["k", "g", "at", "v"]
    assert key(tuple(r) for r in got.collect()) == key([(1, "a", 3, "y"), (1, "a", 3, "y"), (2, "b", None, None), (None, "a", None, None), (2, "a", 1, "w")])


def test_dense_numbers(spark):
    values = [(g, v) for g in ("a", "b", None) for v in range(200)] + [("a", 7), (None, None)]
    df = spark.createDataFrame(values, "g string, v int").repartition(6)
    got = dense_numbers(df, ["v"], ["g"], "no", "of").collect()
    for g in ("a", "b", None):
        own = sorted(((r.no, r.v) for r in got if r.g == g))
        assert [no for no, _ in own] == list(range(len(own))) and {r.of for r in got if r.g == g} == {len(own)}
        assert [v for _, v in own] == sorted((v for h, v in values if h == g), key=lambda v: (v is not None, v))
    whole = dense_numbers(df.distinct(), ["g", "v"]).collect()
    assert sorted(r.number for r in whole) == list(range(601))
    assert dense_numbers(df.limit(0), ["v"]).collect() == []


def test_running_sums(spark):
    values = [(g, v, float(v % 7)) for g in ("a", "b", None) for v in range(200)]
    df = spark.createDataFrame(values, "g string, v int, w double").repartition(6)
    got = running_sums(df, ["v"], ["g"], {"before": "w", "vs": "v"}).collect()
    assert len(got) == 600
    for r in got:
        assert r.before == sum(v % 7 for v in range(r.v)) and r.vs == sum(range(r.v))
    whole = running_sums(df.where("g = 'a'"), ["v"], [], {"before": "w"}).orderBy("v").collect()
    assert [r.before for r in whole] == [sum(v % 7 for v in range(i)) for i in range(200)]
    assert running_sums(df.limit(0), ["v"], ["g"], {"before": "w"}).collect() == []
