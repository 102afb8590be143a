from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from basketry.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_components(fps):
    """fps: (id, fingerprint) pairs; the smallest id reachable, per row."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_against_the_plain_rule():
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "One", "one Two", "a b c", "É é ǅ A", "x" * 90000, "a " * 40000, "a b c a b c", "w\x1cz\x85q  r"]
    texts += [" ".join(rng.choices(["The", "of", "çé", "x9", "\n"], k=rng.randint(1, 60))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def near_family(rng, size):
    """Fingerprints in chains and in a dense ball, so that cells fill up."""
    out = [rng.getrandbits(64) for _ in range(40)]
    at = rng.getrandbits(64)
    for _ in range(40):  # a chain
        out.append(at)
        at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    for _ in range(size):
        x = ball
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(12)
        out.append(x)
    return out


@pytest.mark.parametrize("cell", [2, 32, 10**6])
def test_components_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    fps = list(dict.fromkeys(near_family(random.Random(cell), 150)))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    signed = [simhash._signed(x) for x in fps]
    want = slow_components(list(zip(signed, fps)))
    assert [roots.get(s, s) for s in signed] == want


def test_all_links_of_normal_cells(spark):
    fps = list(dict.fromkeys(near_family(random.Random(9), 60)))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    old, simhash.CELL = simhash.CELL, 10**6
    try:
        got = {tuple(r) for r in simhash.links(df).collect()}
    finally:
        simhash.CELL = old
    signed = [simhash._signed(x) for x in fps]
    want = {tuple(sorted((signed[i], signed[j]))) for i, a in enumerate(fps) for j in range(i) if (a ^ fps[j]).bit_count() <= 2}
    assert got == want and want


def test_segment_counts(spark):
    x = [0, -1, 0x0123456789ABCDEF, -(1 << 63)]
    got = spark.createDataFrame([(v,) for v in x], "fp long").select("fp", simhash.segment_counts(F.col("fp")).alias("v")).collect()
    for r in got:
        u, v = r.fp & (1 << 64) - 1, r.v & (1 << 64) - 1
        assert all((v >> 4 * i & 15) == (u >> 4 * i & 15).bit_count() for i in range(16))


def test_documents_with_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, None), (9, ""), (7, "  \n"), (1, base), (2, base), (2, base), (3, base + " tail"), (4, "quite another text it is"), (None, base), (None, None)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, FP int, root string")
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    want = sorted(zip([d or -1 for d, _ in fps], [f"{f:016x}" for _, f in fps], slow_components([(10**9 if d is None else d, f) for d, f in fps])))
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.digest(df).collect())
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({d for d, _, c in want if d == c})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.digest(df).collect() == [] and simhash.keep_one(df).collect() == []


def test_keep_one_tells_documents_of_one_id(spark):
    a, b = "alpha beta gamma delta one two three", "completely other words here and there now"
    rows = [(3, b, 1, "x", 0), (5, a, 2, "x", 0), (5, b, 3, "x", 0), (7, a, 4, "y", 0), (None, a, 5, "z", 0), (9, "z z z", 6, "z", 0), (9, "z z z", 6, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, fp string, id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    # text a is nowhere else than under 5 and 7, b stays as 3
    assert got == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)
    assert simhash.keep_one(df.limit(0)).collect() == []
    by_int = df.select("text", F.col("doc_id").cast("int").alias("Doc Id"))
    assert simhash.keep_one(by_int, doc_id="Doc Id").count() == 4


def test_keep_one_of_near_copies_under_one_id(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:-1], "changed"]
    x, y = simhash.fingerprint(" ".join(words)), simhash.fingerprint(" ".join(near))
    bits = (x ^ y).bit_count()
    df = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(near)), (2, " ".join(near))], "doc_id long, text string")
    kept = [r.text for r in simhash.keep_one(df, max_bits=2).collect()]
    assert len(kept) == (1 if bits <= 2 else 2) and len(set(kept)) == len(kept)


@pytest.mark.parametrize("max_bits", [1, 2])
def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, monkeypatch, max_bits):
    # Spark takes the 33 cells of a fingerprint for one row, so a size below its threshold says nothing
    plans, plain = [], simhash.written

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(simhash, "written", recorded)
    monkeypatch.setattr(simhash, "CELL", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.sample(words, 100)) for _ in range(30)]
    texts += [texts[0].replace(w, "changed") for w in texts[0].split()[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    found = simhash.digest(df, max_bits=max_bits)
    assert found.count() == 50
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_labels_of_the_pipeline_s_documents_are_not_broadcast(spark, monkeypatch):
    plans, plain = {}, simhash.written

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(simhash, "written", recorded)
    df = spark.createDataFrame([(i, f"a b c {i % 7}") for i in range(20)], "doc_id long, text string")
    assert simhash.keep_one(df).count() == 7
    assert "SortMergeJoin" in plans["simhash-labelled"] and "Broadcast" not in plans["simhash-labelled"]
