"""Property tests: single-pass multi-case metrics equal one-case-at-a-time
metrics on random data."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.metrics import METRICS, basket_metrics
from basketry.operators.evaluate import labelled_metrics

rows_strategy = st.lists(
    st.tuples(
        st.integers(0, 5),  # user
        st.integers(0, 1),  # truth
        st.floats(0, 1, allow_nan=False, width=32),  # score
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy)
def test_labelled_metrics_equals_per_case(spark, rows):
    df = spark.createDataFrame(
        [(u, i, t, float(s)) for i, (u, t, s) in enumerate(rows)],
        "user_id long, product_id long, y_act int, score double",
    )
    cuts = [0.25, 0.5, 0.75]
    cases = [({"cutoff": F.lit(c)}, F.col("score") > F.lit(c)) for c in cuts]
    fast = {
        (r.cutoff, r.user_id): tuple(r[m] for m in METRICS)
        for r in labelled_metrics(df, "user_id", F.col("y_act"), cases).collect()
    }
    slow = {}
    for c in cuts:
        one = basket_metrics(
            df.select("user_id", "y_act", (F.col("score") > F.lit(c)).cast("int").alias("y_hat"))
        )
        for r in one.collect():
            slow[(c, r.user_id)] = tuple(r[m] for m in METRICS)
    assert fast == slow
