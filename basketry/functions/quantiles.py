"""Exact quantiles (R type 7) without gathering a group into one task.

Spark's exact ``percentile`` merges, per group, one count for every distinct
value in a single task.  ``exact_quantiles`` returns the same numbers with
bounded memory:

1. per group: ``n`` and an approximate quantile sketch (``percentile_approx``,
   mergeable, memory set by ``accuracy``) evaluated a little below and above
   each requested probability -- a bracket that must contain the two order
   statistics the interpolation needs (the sketch's rank error is at most
   n / accuracy, the bracket is ``margin`` / accuracy wide on each side);
2. values are reduced to (value, multiplicity) by a partial aggregation;
   only distinct values inside a bracket are ranked exactly, by a running
   count over that slice (bounded by the bracket, not by the group); the
   multiplicities below the bracket enter that window as one summed row;
3. where a bracket may hold more than ``slice_rows`` values, it is sketched
   again by itself and narrowed, until all are below (each pass divides them
   by about ``GRID`` / 2), so no window grows with the group;
4. the order statistics at positions floor(h) and ceil(h), h = (n - 1) p,
   are interpolated with the formula Spark's ``percentile`` uses.

Ties never inflate a slice: a value occurring a billion times is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.lineage import kept

DEFAULT_ACCURACY = 10000
DEFAULT_MARGIN = 10
#: Values that a bracket may hold when it is ranked in one window.
DEFAULT_SLICE_ROWS = 1_000_000
#: Steps of the sketch that narrows a bracket.
GRID = 200


def narrower(data: DataFrame, targets: DataFrame, keys: list[str], accuracy: int, broadcast_targets: bool) -> DataFrame:
    """``targets`` with each bracket narrowed by a sketch of the values in it;
    the counts of those below it are exact."""
    cand = data.join(F.broadcast(targets) if broadcast_targets else targets, keys)
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    same = [c for c in targets.columns if c not in (*keys, "_i", "_lo", "_hi", "_room")]
    sketch = cand.groupBy(*keys, "_i").agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_below"),
        F.count_if(inside).alias("_m"),
        F.percentile_approx(F.when(inside, F.col("_v")), grid, accuracy).alias("_b"),
        *[F.first(c).alias(c) for c in same],
    )
    m = F.col("_m").cast("double")
    slack = F.lit(2.0) * m / F.lit(float(accuracy)) + F.lit(2.0)
    low = F.floor((F.floor("_pos") + 1 - F.col("_below") - slack) / m * GRID)
    high = F.ceil((F.ceil("_pos") + 1 - F.col("_below") + slack) / m * GRID)
    steps = sketch.withColumn("_l", F.greatest(low, F.lit(0)).cast("int")).withColumn("_h", F.least(high, F.lit(GRID)).cast("int"))
    room = ((F.col("_h") - F.col("_l")) / F.lit(float(GRID)) * m + 2 * slack).alias("_room")
    return steps.select(*keys, "_i", *same, F.col("_b")[F.col("_l")].alias("_lo"), F.col("_b")[F.col("_h")].alias("_hi"), room)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    group_cols: list[str] | None = None,
    out_cols: list[str] | None = None,
    accuracy: int = DEFAULT_ACCURACY,
    margin: int = DEFAULT_MARGIN,
    extra_aggs: list | None = None,
    broadcast_targets: bool = True,
    slice_rows: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """One row per group: group columns, then one DOUBLE column per
    probability (``out_cols``, default ``q0, q1, ...``), then the
    ``extra_aggs`` (aggregate columns over the non-NULL values, column
    ``_v``), computed in the same pass as the sketch.  NULL values are
    ignored; a group of only NULLs yields no row.

    ``broadcast_targets``: the per-(group, probability) bracket table has
    exactly ``groups x len(probs)`` rows; it is broadcast to the value
    counts so that no group's values meet in one task.  Keep it for a
    bounded number of groups (summaries); pass False for quantiles per key
    over an unbounded number of keys, where the join on the group key
    already spreads the work."""
    groups = list(group_cols or [])
    keys = groups or ["_all"]
    out_cols = out_cols or [f"q{i}" for i in range(len(probs))]
    data, targets, extra_names = brackets(df, value, probs, groups, accuracy, margin, extra_aggs, broadcast_targets, slice_rows)
    k = len(probs)
    counts = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # one row per (group, probability, distinct value): a fixed fan-out of len(probs)
    cand = counts.join(F.broadcast(targets) if broadcast_targets else targets, keys)
    carried = [*keys, "_i", "_pos", *extra_names]  # of the targets
    # everything below the bracket collapses into one row that sorts first
    below = (
        cand.where(F.col("_v") < F.col("_lo"))
        .groupBy(*carried)
        .agg(F.sum("_c").alias("_c"))
        .select(*carried, F.lit(None).cast("double").alias("_v"), "_c", F.lit(True).alias("_is_below"))
    )
    inside = cand.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).select(
        *carried, "_v", "_c", F.lit(False).alias("_is_below")
    )
    slice_w = (
        Window.partitionBy(*keys, "_i")
        .orderBy(F.col("_is_below").desc(), "_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        inside.unionByName(below)
        .withColumn("_end", F.sum("_c").over(slice_w))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .where(~F.col("_is_below"))
    )

    def covers(i: int, pos):
        return (F.col("_i") == i) & (F.col("_start") <= pos) & (pos < F.col("_end"))

    pos = F.col("_pos")
    aggs = []
    for i in range(k):
        aggs += [
            F.max(F.when(covers(i, F.floor(pos)), F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when(covers(i, F.ceil(pos)), F.col("_v"))).alias(f"_hi{i}"),
            F.max(F.when(F.col("_i") == i, pos)).alias(f"_pos{i}"),
        ]
    aggs += [F.first(c).alias(c) for c in extra_names]
    picked = ranked.groupBy(*keys).agg(*aggs)

    def interpolate(i: int):
        p_, lo_v, hi_v = F.col(f"_pos{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        lo_f, hi_f = F.floor(p_), F.ceil(p_)
        return F.when(hi_f == lo_f, lo_v).otherwise((hi_f - p_) * lo_v + (p_ - lo_f) * hi_v)

    wide = picked.select(*keys, *[interpolate(i).alias(out_cols[i]) for i in range(k)], *extra_names)
    return wide.drop("_all") if not groups else wide



def brackets(
    df: DataFrame,
    value: str,
    probs: list[float],
    groups: list[str],
    accuracy: int = DEFAULT_ACCURACY,
    margin: int = DEFAULT_MARGIN,
    extra_aggs: list | None = None,
    broadcast_targets: bool = True,
    slice_rows: int = DEFAULT_SLICE_ROWS,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """The values (``_v``), one row per (group, probability) with the bracket
    [_lo, _hi], the position ``_pos`` in the group and ``_room``, a bound on the
    values strictly inside, and the names of the extra aggregates.  The rows
    are computed once and kept: they are groups x probabilities."""
    keys = groups or ["_all"]
    data = df.select(*groups, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not groups:
        data = data.withColumn("_all", F.lit(0))

    # Sketch queries: each probability +/- a geometric ladder of offsets,
    # plus the minimum and the maximum.
    eps = margin / accuracy
    ladder = []
    c = eps
    while c < 1.0:
        ladder.append(c)
        c *= 2
    grid: list[float] = [0.0, 1.0]
    for p in probs:
        grid += [p - c for c in ladder if p - c > 0] + [p + c for c in ladder if p + c < 1]
    grid = sorted(set(grid))
    at = {q: i for i, q in enumerate(grid)}
    extras = list(extra_aggs or [])
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(q) for q in grid]), accuracy).alias("_b"),
        *extras,
    )
    extra_names = [c for c in sketch.columns if c not in (*keys, "_n", "_b")]
    n = F.col("_n").cast("double")
    slack = F.lit(2.0) * n / F.lit(float(accuracy)) + F.lit(2.0)

    def bounds(p: float) -> tuple:
        """Narrowest sketch values whose rank guarantee still brackets the
        order statistics at floor(h) and ceil(h) (0-based), h = (n-1) p."""
        h = (n - 1) * F.lit(p)
        need_lo, need_hi = F.floor(h) + 1, F.ceil(h) + 1  # 1-based ranks

        def edge(q: float):
            return F.struct(F.col("_b")[at[q]].alias("v"), F.lit(q).alias("q"))

        lo = F.coalesce(
            *[F.when(F.lit(p - c) * n + slack <= need_lo, edge(p - c)) for c in ladder if p - c > 0], edge(0.0)
        )
        hi = F.coalesce(
            *[F.when(F.lit(p + c) * n - slack >= need_hi, edge(p + c)) for c in ladder if p + c < 1], edge(1.0)
        )
        return lo, hi

    structs = []
    for i, p in enumerate(probs):
        lo, hi = bounds(p)
        structs.append(
            F.struct(
                F.lit(i).alias("_i"),
                F.lit(float(p)).alias("_p"),
                lo["v"].alias("_lo"),
                hi["v"].alias("_hi"),
                ((hi["q"] - lo["q"]) * n + 2 * slack).alias("_room"),
            )
        )
    targets = sketch.select(*keys, "_n", *extra_names, F.inline(F.array(*structs))).withColumn(
        "_pos", (F.col("_n") - 1).cast("double") * F.col("_p")
    )
    targets = kept(targets)
    room = targets.agg(F.max("_room")).first()[0] or 0.0
    while room > slice_rows:
        closer = kept(narrower(data, targets, keys, accuracy, broadcast_targets))
        left = closer.agg(F.max("_room")).first()[0]
        if left >= room:
            break  # as narrow as this accuracy makes it
        targets, room = closer, left
    return data, targets, extra_names
