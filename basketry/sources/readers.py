"""Readers: the reference's six CSV inputs (S1) and the driver's parquet."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from basketry.sources.schemas import CSV_FILES


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_basket_csv(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six reference CSV files under ``root`` with declared schemas.

    Header row, comma separated; ``days_since_prior_order`` is empty on a
    user's first order and reads as NULL.  No schema inference: at scale an
    inference pass is a full extra scan and can guess types wrongly.
    """
    frames = {}
    for name, (file_name, schema) in CSV_FILES.items():
        frames[name] = (
            spark.read.schema(schema)
            .option("header", True)
            .option("mode", "FAILFAST")
            .csv(os.path.join(root, file_name))
        )
    return frames


def read_basket_parquet(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Same six tables stored as parquet directories named by table."""
    return {name: spark.read.parquet(os.path.join(root, name)) for name in CSV_FILES}
