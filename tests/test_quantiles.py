"""Bounded exact quantiles equal Spark's exact percentile."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.quantiles import brackets, exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


def _exact(df, probs):
    return df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q"))


@pytest.mark.parametrize(
    "n,distinct,accuracy",
    [
        (1, 1, 100), (2, 2, 100), (4, 4, 100), (7, 7, 10000), (150, 150, 10000),
        (451, 451, 10000), (1000, 7, 100), (20000, 20000, 100), (20000, 300, 50),
        (50000, 50000, 10000),
    ],
)
def test_matches_spark_percentile(spark, n, distinct, accuracy):
    rnd = random.Random(n * 31 + distinct)
    rows = [(i % 3, float(rnd.randrange(distinct)) / 7.0) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {
        r.g: [r[f"q{i}"] for i in range(len(PROBS))]
        for r in exact_quantiles(df, "v", PROBS, ["g"], accuracy=accuracy).collect()
    }
    want = {r.g: list(r.q) for r in _exact(df, PROBS).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12), g


def test_ungrouped_and_r_type7(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    r = exact_quantiles(df, "v", [0.25, 0.5, 0.75], out_cols=["a", "b", "c"]).collect()[0]
    assert (r.a, r.b, r.c) == (1.75, 2.5, 4.75)


@pytest.mark.parametrize("slice_rows", [20000, 300, 60])
def test_no_slice_is_larger_than_asked(spark, slice_rows):
    rnd = random.Random(slice_rows)
    rows = [(i % 2, rnd.random() if i % 5 else float(i % 3)) for i in range(30000)]
    df = spark.createDataFrame(rows, "g int, v double")
    data, targets, _ = brackets(df, "v", PROBS, ["g"], accuracy=100, slice_rows=slice_rows)
    inside = data.join(targets, "g").where("_v >= _lo and _v <= _hi").groupBy("g", "_i").agg(F.count_distinct("_v").alias("n"))
    assert inside.agg(F.max("n")).first()[0] <= slice_rows + 2
    got = {r.g: [r[f"q{i}"] for i in range(len(PROBS))] for r in exact_quantiles(df, "v", PROBS, ["g"], accuracy=100, slice_rows=slice_rows).collect()}
    for r in _exact(df, PROBS).collect():
        assert got[r.g] == pytest.approx(list(r.q), rel=1e-12, abs=1e-12)
