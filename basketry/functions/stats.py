"""Summary statistics with R's conventions, as Spark aggregate expressions.

* quantiles interpolate linearly between order statistics (R type 7), which
  is what Spark's exact ``percentile`` does;
* the six-number summary is Min., 1st Qu., Median, Mean, 3rd Qu., Max.;
* standard error is the sample standard deviation over sqrt(n);
* histogram bins are right-closed with the lowest bin closed on both sides.

Quantiles come from ``quantiles.exact_quantiles``: exact (R type 7), with
memory bounded by a sketch accuracy instead of the number of distinct
values in a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.quantiles import exact_quantiles

# The row labels and probabilities of R's six-number summary.
SUMMARY_STATS = ["Min.", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max."]
QUARTILES = [0.25, 0.5, 0.75]


def standard_error(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.stddev_samp(c) / F.sqrt(F.count(F.lit(1)))


def six_number_summary(
    df: DataFrame, cols: list[str], group_cols: list[str] | None = None
) -> DataFrame:
    """R's ``apply(m, 2, summary)``: one row per statistic (``stat``), one
    DOUBLE column per input column, per group.

    The input columns are stacked into (metric, value) rows (a fixed fan-out
    of ``len(cols)``); min / mean / max are one partial aggregation and the
    quartiles come from ``exact_quantiles`` (bounded memory, exact)."""
    groups = list(group_cols or [])
    long = df.select(
        *groups,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_x"))
                    for c in cols
                ]
            )
        ),
    )
    per_metric = exact_quantiles(
        long,
        "_x",
        QUARTILES,
        groups + ["_metric"],
        out_cols=["_q1", "_q2", "_q3"],
        extra_aggs=[F.min("_v").alias("_min"), F.avg("_v").alias("_mean"), F.max("_v").alias("_max")],
    )
    stat_value = {
        "Min.": "_min",
        "1st Qu.": "_q1",
        "Median": "_q2",
        "Mean": "_mean",
        "3rd Qu.": "_q3",
        "Max.": "_max",
    }
    stats = per_metric.select(
        *groups,
        "_metric",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stat"), F.col(stat_value[s]).alias("_value"))
                    for s in SUMMARY_STATS
                ]
            )
        ),
    )
    return stats.groupBy(*groups, "stat").agg(
        *[F.max(F.when(F.col("_metric") == c, F.col("_value"))).alias(c) for c in cols]
    )


def right_closed_bin(x: Column, lo: float, width: float, bins: int) -> Column:
    """1-based bin of ``x`` for fixed-width bins (lo, lo+w], ... with the
    lowest edge included.  A relative fuzz of 1e-9 keeps values that sit on
    an edge (0.07 * 100 = 7.000000000000001) in the bin they close."""
    pos = (x - F.lit(lo)) / F.lit(width)
    b = F.ceil(pos - F.lit(1e-9)).cast("int")
    return F.least(F.greatest(b, F.lit(1)), F.lit(bins))
