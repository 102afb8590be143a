"""Mixing sources to target weights by hierarchical budgets.

The documents form a tree, here domain, language, source.  A token budget
goes from the root down.  Each node divides its budget among its children by
their weights; a child that cannot use its share (its tokens times the
largest number of epochs) leaves the shortage to its siblings, by their
weights again.  Only what all children of a node together cannot use was
never given to the node: the node's own siblings got it.  So a shortage goes to
siblings before ancestors' siblings.  (``divide`` solves one level in closed form
over sorted prefix sums.)

A leaf with a budget of e whole epochs and a rest takes all its documents e
times, and of epoch e + 1 the longest prefix within the rest, in the order of
a hash seeded by the epoch.  The cut is found without sorting a leaf: token
sums of ``BUCKETS`` hash ranges show the range it falls into, and only that
range is accumulated.  So a source of any size is spread over all tasks, and
what decides about a document is one threshold a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import WS, quoted, written

#: Hash ranges of a leaf; the cut is searched in one of them.
BUCKETS = 4096
Path = tuple[str | None, ...]


def n_words(text: Column) -> Column:
    """The token measure: words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def _same(a: DataFrame, b: DataFrame, cols: list[str], suffix: str = "_r") -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c + suffix]) for c in cols], F.lit(True))


def _renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c + "_r") if c in cols else F.col(c) for c in df.columns])


def _with_weights(nodes: DataFrame, levels: list[str], weights: dict[Path, float]) -> DataFrame:
    """``nodes`` (one level of the tree) and ``weight``: what ``weights`` says
    of the path; the rest up to 1 goes to the siblings it does not name, in
    equal parts."""
    own = [(p, float(w)) for p, w in weights.items() if len(p) == len(levels)]
    named = F.lit(None).cast("double")
    for path, w in own:
        named = F.when(reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(levels, path)]), F.lit(w)).otherwise(named)
    parent = Window.partitionBy(*levels[:-1]) if len(levels) > 1 else Window.partitionBy(F.lit(0))
    rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("named").over(parent), F.lit(0.0)))
    unnamed = F.sum(F.col("named").isNull().cast("int")).over(parent)
    return nodes.withColumn("named", named).withColumn("weight", F.coalesce("named", F.try_divide(rest, unnamed))).drop("named")


def divide(children: DataFrame, parents: list[str]) -> DataFrame:
    """Divide ``budget`` (of the parent, on each child) into ``share``: a
    share is the smaller of ``capacity`` and weight x level, with the level
    that uses the budget up or all capacity of children with a weight."""
    keys = parents or [F.lit(0)]
    able = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)).cast("double")
    one = children.withColumn("able", able).withColumn("full_at", F.when(F.col("weight") > 0, F.try_divide(F.col("able"), F.col("weight"))).otherwise(F.lit(-1.0)))
    order = Window.partitionBy(*keys).orderBy("full_at", *[c for c in children.columns if c not in (*parents, "budget")])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    two = one.withColumn("is_full", F.coalesce(F.sum("able").over(before), F.lit(0.0)) + F.col("full_at") * F.sum("weight").over(onwards) <= F.col("budget"))
    whole = Window.partitionBy(*keys)
    left = F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("able")).otherwise(0.0)).over(whole)
    hungry = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("weight"))).over(whole)
    share = F.when(F.col("is_full"), F.col("able")).otherwise(F.least("able", F.try_divide(F.col("weight") * left, hungry)))
    return two.withColumn("share", F.when(F.col("weight") > 0, share).otherwise(0.0)).drop("able", "full_at", "is_full")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[Path, float], budget: float, max_epochs: int) -> DataFrame:
    """``leaves`` (the level columns and ``tokens``) with ``budget``, whole tokens."""
    nodes: list[DataFrame] = []
    for depth in range(len(levels), 0, -1):  # capacities from the leaves up
        cols = levels[:depth]
        if depth == len(levels):
            at = leaves.select(*cols, (F.col("tokens") * max_epochs).cast("double").alias("capacity"))
        else:
            below = nodes[0]
            at = below.groupBy(*cols).agg(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).alias("capacity"))
        nodes.insert(0, _with_weights(at, cols, weights))
    given = divide(nodes[0].withColumn("budget", F.lit(float(budget))), [])
    for depth in range(2, len(levels) + 1):  # budgets from the root down
        up, cols = levels[: depth - 1], levels[:depth]
        parents = _renamed(given.select(*up, F.col("share").alias("budget")), up)
        here = nodes[depth - 1].join(parents, _same(nodes[depth - 1], parents, up)).select(*cols, "capacity", "weight", "budget")
        given = divide(here, up)
    # Rounded before the floor, as sums of doubles end a little off whole numbers.
    done = _renamed(given.select(*levels, F.floor(F.round("share", 3)).alias("budget")), levels)
    return leaves.join(done, _same(leaves, done, levels)).select(*[leaves[c] for c in leaves.columns], "budget")


def _order(seed: int, epoch: Column, row: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), row)


def _bucket(order: Column) -> Column:
    return F.shiftright(order, 52)  # 12 bits, ascending with the order


def plan(rows: DataFrame, levels: list[str], weights: dict[Path, float], share: float, max_epochs: int, seed: int) -> DataFrame:
    """From narrow rows (levels, row hash, n_tokens): per leaf ``tokens``,
    ``budget``, ``whole`` epochs and ``cut``: the order value from which on
    epoch ``whole`` + 1 is left out (null: nothing is left out)."""
    leaves = written(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    full = F.when(F.col("tokens") > 0, F.floor(F.try_divide(F.col("budget"), F.col("tokens")))).otherwise(F.lit(0))
    given = budgets(leaves, levels, weights, share * total, max_epochs).withColumn("whole", full.cast("int"))
    given = written(given.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-budgets")
    partial = _renamed(given.select(*levels, "whole", "rest"), levels)
    keyed = rows.join(partial, _same(rows, partial, levels)).withColumn("order", _order(seed, F.col("whole") + 1, F.col("row")))
    ranges = keyed.groupBy(*levels, _bucket(F.col("order")).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy(*levels).orderBy("bucket")  # BUCKETS rows a leaf at most
    summed = ranges.withColumn("end", F.sum("n").over(ahead)).where("end > rest")
    edge = summed.groupBy(*levels).agg(F.min(F.struct("bucket", (F.col("end") - F.col("n")).alias("before"))).alias("e"))
    edge = _renamed(edge.select(*levels, "e.bucket", "e.before"), levels)
    inside = keyed.join(edge, _same(keyed, edge, levels) & (_bucket(F.col("order")) == F.col("bucket"))).select(*[keyed[c] for c in levels], "order", "n_tokens", "rest", "before")
    by_order = inside.groupBy(*levels, "order").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = Window.partitionBy(*levels).orderBy("order")
    cuts = by_order.withColumn("end", F.col("before") + F.sum("n").over(upto)).where("end > rest").groupBy(*levels).agg(F.min("order").alias("cut"))
    cuts = _renamed(cuts, levels)
    return written(given.join(cuts, _same(given, cuts, levels), "left").select(*[given[c] for c in given.columns], "cut"), "mix-plan")


def mix(
    df: DataFrame,
    levels: dict[str, Column],
    weights: dict[Path, float],
    share: float,
    max_epochs: int = 1,
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
    epoch: str = "epoch",
) -> DataFrame:
    """The rows of ``df`` that the mix takes, once for each epoch, with all
    their columns and ``epoch`` (from 1).

    ``levels`` names the tree's levels and how each follows from the row,
    ``weights`` the weights of paths among their siblings, ``share`` the
    budget as a share of all tokens (words).  A null level value is a node
    of its own.  Rows of the same id and text are taken or left together;
    rows without tokens cost nothing and follow their place in the order.  A
    leaf without tokens, or without a budget, takes none but those before its
    first token.  Empty tables give none."""
    names = [f"_level{i}" for i in range(len(levels))]
    paths = [c.cast("string").alias(n) for n, c in zip(names, levels.values())]
    row = F.xxhash64(quoted(doc_id), quoted(text))
    rows = written(df.select(*paths, row.alias("row"), n_words(quoted(text)).alias("n_tokens")), "mix-rows")
    chosen = _renamed(plan(rows, names, weights, share, max_epochs, seed).select(*names, "whole", "rest", "cut"), names)
    chosen = chosen.withColumnsRenamed({"whole": "_whole", "rest": "_rest", "cut": "_cut"})
    kept = [c for c in df.columns if c.lower() != epoch.lower()]
    docs = df.select(*[quoted(c) for c in kept], *paths)
    joined = docs.join(chosen, _same(docs, chosen, names))
    # Without a rest no epoch is begun, not even for rows that cost nothing.
    last = (F.col("_rest") > 0) & (F.col("_cut").isNull() | (_order(seed, F.col("_whole") + 1, row) < F.col("_cut")))
    times = F.col("_whole") + F.when(last & (F.col("_whole") < max_epochs), 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return joined.select(*[quoted(c) for c in kept], F.explode(epochs).alias(epoch))
