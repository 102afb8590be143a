"""Predicted baskets for target orders that arrive as a stream.

The reference is a batch job; this module runs its submission rule
(re-ordered products of the last three prior orders, ``None`` when there
are none) continuously: new target orders land as files and every
micro-batch is joined to the per-user candidate pairs.  Those pairs are
derived from the order history ONCE when the stream starts (which is why the
stream takes what has arrived and ends, and does not run on) and written to
the checkpoint folder (lineage cut), so a micro-batch reads a compact
(user, product) table instead of scanning the whole history.  Each micro-batch writes into its own epoch folder with
overwrite, so a batch replayed after a failure replaces its earlier output
(exactly-once files); progress is tracked in the stream's checkpoint
folder under the session's checkpoint directory.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.functions.lineage import cut_lineage
from basketry.session import checkpoint_dir
from basketry.operators.submit import baskets_per_order, fill_none, last3_reorder_pairs
from basketry.sources.schemas import ORDERS


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir (a shared folder) before starting a stream")
    return os.path.join(base.replace("file:", ""), "streams", name)


def basket_writer(pairs: DataFrame, sink_dir: str):
    """foreachBatch function: baskets (or None) for the batch's test orders,
    from precomputed (user_id, product_id) candidate pairs."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        targets = batch.where(F.col("eval_set") == "test").select("user_id", "order_id")
        baskets = fill_none(baskets_per_order(pairs, targets), targets)
        baskets.write.mode("overwrite").parquet(os.path.join(sink_dir, f"epoch={epoch_id}"))

    return write


def start_basket_stream(
    spark: SparkSession,
    prior_items: DataFrame,
    landing_dir: str,
    sink_dir: str,
    name: str = "baskets",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the stream over parquet order files (basket ``orders`` schema)
    dropped into ``landing_dir``."""
    reader = spark.readStream.schema(ORDERS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pairs = cut_lineage(last3_reorder_pairs(prior_items))
    writer = (
        reader.parquet(landing_dir)
        .writeStream.foreachBatch(basket_writer(pairs, sink_dir))
        .option("checkpointLocation", stream_checkpoint(spark, name))
    )
    return writer.trigger(availableNow=True).start()
