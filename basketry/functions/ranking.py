"""Row numbers within groups that may be very large.

``row_number().over(partitionBy(g).orderBy(o))`` sends every row of a group
to one task.  ``blocked_row_number`` cuts the ordering key into blocks
(``o div block``) and combines two bounded windows:

* a row number inside each (group, block)         -- at most ``block`` rows;
* a running count of the group's earlier blocks   -- one row per block.

The big side is hashed on (group, block) once: the per-block counts read the
same shuffle, and the join back reuses its partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def blocked_row_number(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    out_col: str = "row_number",
    block: int = DEFAULT_BLOCK,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """``df`` plus ``out_col`` = 1-based position of the row in its group by
    ``order_col`` (a non-negative integer column), then by the ``tie_break``
    columns (without them ties are numbered in an arbitrary order, as with
    ``row_number``).  Blocks cut ``order_col`` only, so equal keys share a
    block and the tie-break applies inside it."""
    blk = "_blk"
    # rows without a key match no block below; left out here, both uses of the
    # rows have the same plan
    keyed = df.withColumn(blk, F.floor(F.col(order_col) / F.lit(block)))
    keyed = keyed.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*group_cols, blk]]))
    inner = keyed.withColumn(
        "_rn_in_block",
        F.row_number().over(
            Window.partitionBy(*group_cols, blk).orderBy(order_col, *(tie_break or []))
        ),
    )
    # counted as the last number inside: both uses read one shuffle of the rows
    per_block = inner.groupBy(*group_cols, blk).agg(F.max("_rn_in_block").alias("_n"))
    offsets = per_block.select(
        *group_cols,
        blk,
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(*group_cols)
                .orderBy(blk)
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        inner.join(offsets, [*group_cols, blk])
        .withColumn(out_col, (F.col("_before") + F.col("_rn_in_block")).cast("int"))
        .drop(blk, "_rn_in_block", "_before")
    )
