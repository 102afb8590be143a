"""CSV sink for submissions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def submission_path(root: str, cutoff: float | None = None, max_depth: int | None = None, name: str = "submit") -> str:
    """Output directory named after the run parameters."""
    parts = [name]
    if cutoff is not None:
        parts.append(f"c{round(cutoff * 100)}")
    if max_depth is not None:
        parts.append(f"md{max_depth}")
    return os.path.join(root, "_".join(parts))


def write_submission(df: DataFrame, path: str) -> None:
    """Header CSV without row names, one file per task.

    The submission is ordered by order_id (range-partitioned), so part
    files concatenated in name order are globally sorted; nothing is
    funnelled through a single task."""
    df.write.mode("overwrite").option("header", True).csv(path)
