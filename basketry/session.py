"""Session construction and the SQL settings this workload relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job in this package expects.  They are SQL confs, so they
# can be applied to an existing session (the driver's) at run time.
WORKLOAD_CONF = {
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, turn joins into broadcasts once real sizes are known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where that costs one more shuffle (an
    # aggregate or join above that could have reused the partitioning).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins on (user_id, product_id) hash on BOTH keys (Spark's default,
    # stated here on purpose): reusing a user_id-only partitioning would
    # save an exchange but keep a dominant user in one task.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def tune_session(spark: SparkSession) -> SparkSession:
    for key, value in WORKLOAD_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "basketry",
    cpus: int | str | None = None,
    shuffle_partitions: int | None = None,
    event_log_dir: str | None = None,
) -> SparkSession:
    """Local session for tests, bench and command-line use."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    if shuffle_partitions is None:
        shuffle_partitions = int(cpus) if str(cpus).isdigit() else 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        builder = (
            builder.config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", event_log_dir)
            .config("spark.eventLog.rolling.enabled", "false")
            .config("spark.eventLog.compress", "false")
        )
    for key, value in WORKLOAD_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_id(spark: SparkSession) -> str:
    """Application id (falls back to the session conf where the session
    exposes no SparkContext, e.g. Spark Connect)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", "app")


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The session's checkpoint folder (``spark.checkpoint.dir``) or None."""
    try:
        found = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001
        found = None
    return found or spark.conf.get("spark.checkpoint.dir", None)
