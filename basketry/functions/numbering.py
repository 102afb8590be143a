"""Dense numbers and running sums over a whole table, or over groups that may
be very large.

``row_number()`` or a running sum over one window gathers the table (or the
group) in one task.  Here the rows are range-partitioned and sorted, written
once with their partition and their place in it, and numbered or summed by
adding the count or sum of all earlier partitions.  The windows left have one
row per (group, range partition), or the rows of one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.lineage import kept


def dense_numbers(
    df: DataFrame,
    order: list[str],
    by: list[str] | None = None,
    number: str = "number",
    total: str | None = None,
    save: Callable[[DataFrame], DataFrame] = kept,
) -> DataFrame:
    """``df`` plus ``number`` (0-based long): the row's place among the rows of
    equal ``by`` columns (nulls equal each other) in ascending ``order``, nulls
    first; and, if named, ``total``: the number of such rows.  Rows with equal
    keys get different numbers in an order that ``save`` fixes; give enough
    ``order`` columns to tell them apart, as equal keys also share a
    partition.  ``save`` writes a table and reads it back."""
    by = by or []
    placed = _placed(df, order, by, save)
    pieces = placed.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    starts = pieces.select(
        *[F.col(c).alias(f"_of_{c}") for c in by],
        F.col("_part").alias("_of_part"),
        (_earlier("_n", by) - F.col("_first")).alias("_start"),
        F.sum("_n").over(group).alias("_total"),
    )
    found = placed.join(starts, _same_piece(by))
    totals = [F.col("_total").alias(total)] if total else []
    return found.select(*df.columns, (F.col("_row") + F.col("_start")).alias(number), *totals)


def running_sums(
    df: DataFrame,
    order: list[str],
    by: list[str] | None = None,
    sums: dict[str, str] | None = None,
    save: Callable[[DataFrame], DataFrame] = kept,
) -> DataFrame:
    """``df`` plus, for each column of ``sums`` (name: column), the sum of that
    column over all earlier rows of the group, 0 for the first one.  Groups,
    order and ``save`` are those of ``dense_numbers``."""
    by, sums = by or [], sums or {}
    placed = _placed(df, order, by, save)
    pieces = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    starts = pieces.select(
        *[F.col(c).alias(f"_of_{c}") for c in by],
        F.col("_part").alias("_of_part"),
        *[_earlier(f"_s_{n}", by).alias(f"_b_{n}") for n in sums],
    )
    inside = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    here = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_h_{n}") for n, c in sums.items()])
    found = here.join(starts, _same_piece(by))
    return found.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_h_{n}")).alias(n) for n in sums])


def _placed(df: DataFrame, order: list[str], by: list[str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sorted rows, with their range partition and ascending places, saved once."""
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return save(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))


def _earlier(column: str, by: list[str]) -> Column:
    """The sum over all earlier partitions of the group."""
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0))


def _same_piece(by: list[str]) -> Column:
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_of_part"))
