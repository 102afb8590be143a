"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage in the session's checkpoint folder (the
    cluster's shared folder): a parquet table written into it, deleted when
    the application ends.  Columns are encoded and compressed there, which a
    checkpoint's serialised rows are not, and the planner knows the size.
    Never a machine-local checkpoint: without a folder this raises."""
    from basketry.session import checkpoint_dir
    from basketry.sources import files

    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/')}/lineage-{uuid.uuid4().hex}"
    files.delete_at_end(spark, path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A small derived table, computed once: in the checkpoint folder, or
    persisted where a session names none (its lineage stays, so a lost
    executor recomputes it)."""
    from basketry.session import checkpoint_dir

    return cut_lineage(df) if checkpoint_dir(df.sparkSession) else df.persist(StorageLevel.MEMORY_AND_DISK)
