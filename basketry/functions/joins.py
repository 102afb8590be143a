"""Joining a per-key aggregate back onto the rows it was computed from.

AQE splits a skewed partition of a sort-merge join only when BOTH join
inputs are shuffles that the planner inserted for the join
(ENSURE_REQUIREMENTS).  An aggregate joined back on its own grouping keys
reuses the aggregate's exchange, and a user ``repartition`` is not
eligible either, so a dominant key of the large side would stay in one
task.

``join_back`` joins the aggregate side on a value-preserving copy of its
keys (``~~k``, a double bitwise NOT the optimiser does not fold).  The
aggregate's hash partitioning no longer matches the join keys, the planner
adds a regular exchange of the (one row per key) aggregate right below the
join, and AQE can then split a dominant key of the large side and
replicate the matching aggregate rows.  AQE still turns the join into a
broadcast when the measured aggregate is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def join_back(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """At least one key must be an integer; keys of other types are renamed
    only, which leaves the joined set of keys new all the same."""
    shadow = {k: f"_jb_{k}" for k in keys}
    kinds = dict(per_key.dtypes)
    side = per_key.select(
        *[
            (F.bitwise_not(F.bitwise_not(F.col(k))) if kinds[k] in INTEGRAL else F.col(k)).alias(shadow[k])
            for k in keys
        ],
        *[c for c in per_key.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [rows[k] == side[shadow[k]] for k in keys])
    return rows.join(side, cond, how).drop(*shadow.values())


def first_rows(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by the ``order`` columns, then by all
    others (a table has no first row).  A partial aggregation, so a key with
    many rows is no task of its own."""
    lead = [*order, *[c for c in table.columns if c not in (*keys, *order)]]
    first = table.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("_first"))
    return first.select(*[(F.col(c) if c in keys else F.col(f"_first.{c}")).alias(c) for c in table.columns])


def first_match(lines: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Look up each line in a table of at most one row per key: every line
    comes out once, with NULLs where nothing matches (a NULL key matches
    nothing)."""
    return join_back(lines, firsts, keys, "left")
