"""The streamed submission equals the batch submission."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from basketry.operators.submit import submission_last3_none
from basketry.streaming.baskets import start_basket_stream
from frames import rows


def test_stream_matches_batch(spark, small_tables):
    landing = tempfile.mkdtemp(prefix="basketry-landing-")
    sink = tempfile.mkdtemp(prefix="basketry-sink-")
    test_orders = small_tables.orders.where(F.col("eval_set") == "test")
    # two arrivals: even and odd order ids, each its own file drop
    for i, part in enumerate((0, 1)):
        test_orders.where(F.col("order_id") % 2 == part).write.parquet(
            os.path.join(landing, f"drop{i}")
        )
    q = start_basket_stream(
        spark, small_tables.prior_items, os.path.join(landing, "*"), sink,
        name="test-" + os.path.basename(sink), max_files_per_trigger=1,
    )
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert rows(out, "order_id", "products") == rows(
        submission_last3_none(small_tables), "order_id", "products"
    )
