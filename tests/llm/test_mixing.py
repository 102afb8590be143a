from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import mixing


def fill(budget, kids):
    """kids: {name: (capacity, weight)}; water-filling by plain steps."""
    share = {k: 0.0 for k in kids}
    open_ = {k for k, (c, w) in kids.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(kids[k][1] for k in open_)
        step = {k: min(left * kids[k][1] / total, kids[k][0] - share[k]) for k in open_}
        for k, s in step.items():
            share[k] += s
        left -= sum(step.values())
        open_ = {k for k in open_ if kids[k][0] - share[k] > 1e-9}
    return share


def slow_budgets(leaves, weights, budget, epochs):
    """leaves: {path: tokens}; the budgets of the leaves, top down."""
    depth = len(next(iter(leaves)))
    nodes = {p[:d] for p in leaves for d in range(1, depth + 1)}

    def kids(p):
        return sorted((n for n in nodes if len(n) == len(p) + 1 and n[: len(p)] == p), key=str)

    def weight(p):
        group = kids(p[:-1])
        named = {k: weights[k] for k in group if k in weights}
        return named[p] if p in named else max(0.0, 1 - sum(named.values())) / (len(group) - len(named))

    def capacity(p):
        return leaves[p] * epochs if len(p) == depth else sum(capacity(k) for k in kids(p) if weight(k) > 0)

    out = {}

    def down(p, b):
        if len(p) == depth:
            out[p] = b
            return
        for k, s in fill(b, {k: (capacity(k), weight(k)) for k in kids(p)}).items():
            down(k, s)

    down((), budget)
    return out


W = {("a",): 0.7, ("a", "x"): 0.9, ("b", "y"): 0.0, ("a", "x", "s"): 0.8, ("c",): 0.05, ("b", "x", None): 0.5}
LEVELS = ["d", "l", "s"]


@pytest.mark.parametrize("seed", range(6))
def test_budgets_against_plain_steps(spark, seed):
    rng = random.Random(seed)
    paths = [(d, g, s) for d in ("a", "b", "c") for g in ("x", "y") for s in ("s", "t", None)]
    leaves = {p: rng.choice([0, 5, 100, 1000, 20000]) for p in rng.sample(paths, 12)}
    budget, epochs = sum(leaves.values()) * rng.choice([0.1, 0.6, 1.5, 9.0]), rng.choice([1, 3])
    df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "d string, l string, s string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, LEVELS, W, budget, epochs).collect()}
    want = slow_budgets(leaves, W, budget, epochs)
    assert set(got) == set(want)
    for p, b in want.items():
        assert abs(got[p] - b) <= 1.001, (p, got[p], b)


def make(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        d, g, s = rng.choices(["a", "b", None], [6, 3, 1])[0], rng.choice("xy"), rng.choice(["s", "t", None])
        text = rng.choice([None, "", "w " * rng.randint(1, 300)]) if i % 9 == 0 else "w " * rng.randint(1, 60)
        rows.append((i, text, d, g, s, "old"))
    rows += rows[:40] + [(None, "w w w", "a", "x", "s", "old"), (10**6, "w " * 30000, "a", "x", "s", "old")]
    return spark.createDataFrame(rows, "doc_id long, text string, d string, l string, s string, EPOCH string"), rows


@pytest.mark.parametrize("share,epochs,buckets", [(0.5, 1, 52), (0.9, 3, 52), (3.0, 2, 62)])
def test_prefixes_against_a_sort(spark, monkeypatch, share, epochs, buckets):
    monkeypatch.setattr(mixing, "_bucket", lambda order: F.shiftright(order, buckets))
    df, rows = make(spark)
    out = mixing.mix(df, {c: F.col(c) for c in LEVELS}, W, share, epochs)
    assert out.columns == ["doc_id", "text", "d", "l", "s", "epoch"]
    got = Counter((r.doc_id, r.text, r.epoch) for r in out.collect())
    leaves, members = defaultdict(int), defaultdict(list)
    for doc, text, *path, _ in rows:
        leaves[tuple(path)] += len((text or "").split())
        members[tuple(path)].append((doc, text))
    table = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "d string, l string, s string, tokens long")
    budget = {tuple(r)[:3]: r.budget for r in mixing.budgets(table, LEVELS, W, share * sum(leaves.values()), epochs).collect()}
    orders = {}
    for e in range(1, epochs + 1):
        h = df.select("doc_id", "text", mixing._order(7, F.lit(e), F.xxhash64("doc_id", "text")).alias("h"))
        orders[e] = {(r.doc_id, r.text): r.h for r in h.collect()}
    want: Counter = Counter()
    for p, docs in members.items():
        whole, rest = divmod(budget[p], leaves[p]) if leaves[p] else (0, 0)
        for e in range(1, whole + 1):
            want.update((d, t, e) for d, t in docs)
        if rest:
            spent, order = 0, orders[whole + 1]
            for h in sorted({order[x] for x in docs}):
                group = [x for x in docs if order[x] == h]
                spent += sum(len((t or "").split()) for _, t in group)
                if spent > rest:
                    break
                want.update((d, t, whole + 1) for d, t in group)
    assert got == want


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("a", "x", "s"): 10, ("a", "x", "t"): 1000, ("a", "y", "s"): 1000, ("b", "x", "s"): 1000}
    df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "d string, l string, s string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, LEVELS, {("a", "x", "s"): 0.9}, 800.0, 1).collect()}
    # a/x has 200: s can use 10 of its 180, so t gets the rest; y and b keep theirs.
    assert got == {("a", "x", "s"): 10, ("a", "x", "t"): 190, ("a", "y", "s"): 200, ("b", "x", "s"): 400}


def test_empty_table(spark):
    df, _ = make(spark)
    assert mixing.mix(df.limit(0), {c: F.col(c) for c in LEVELS}, W, 0.5).collect() == []
