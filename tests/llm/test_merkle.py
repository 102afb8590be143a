from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from basketry.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    d, s, g, n, t = row
    n = n if n is None else n + more
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, g, n, t)))


def tree(nodes):
    """Levels from the leaves to the one top node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def walk(levels, i, digest):
    """Siblings from a node to the top, and the digest that follows."""
    proof = ""
    for level in levels[:-1]:
        pair = level[i - i % 2 : i - i % 2 + 2]
        proof += "".join(x for j, x in enumerate(pair) if j != i % 2)
        pair[i % 2] = digest
        digest, i = sha("".join(pair)), i // 2
    return proof, digest


def brute(rows):
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf_of(r) for r in langs[g]]) for g in order if not langs[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(langs[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low, digest = walk(trees[g], i, leaf_of(r, 1 if hit else 0))
            high, folded = walk(top, at, digest)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, sha(low + high), folded, folded == root))
    return out


def documents(n, langs=("en", "de", None, "")):
    rng = random.Random(n)
    return [(i * 3 % 1009 + 2000 * (i // 1009), rng.choice(["s", None, "é"]), rng.choice(langs), rng.choice([None, 0, 9, 10**12]), rng.choice([None, "", "a\nb", "日本"])) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def same(spark, rows, levels=12):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in merkle.manifest(df, merkle.Shape(levels=levels)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_against_brute_force(spark, levels):
    same(spark, documents(173 if levels > 1 else 30), levels)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_tables(spark, n):
    same(spark, documents(n))
    same(spark, documents(n, langs=["en"]))


def test_many_languages_make_a_deep_top_tree(spark):
    same(spark, documents(90, langs=[f"l{i}" for i in range(40)]), 2)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = documents(20) + documents(20)[:5] + [(None, None, None, None, None), (3, "x", "en", 2**63 - 1, "t " * 90000)]
    same(spark, rows)
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA + ", idx int, tree string")
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str) == sorted(brute(rows), key=str)
    assert merkle.manifest(df.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_the_queue_spills_sorted_runs(limit):
    rng = random.Random(limit)
    queue, want = merkle.LabelQueue(limit), []
    for i in range(500):
        if want and rng.random() < 0.4:
            want.sort()
            assert queue.label() == want[0][0] and queue.pop() == want.pop(0)[1]
        label = rng.randrange(60)
        queue.push(label, i)
        want.append((label, i))
    assert [queue.pop() for _ in range(len(want))] == [m for _, m in sorted(want)]
    assert queue.label() is None


def test_sweeps_do_not_depend_on_the_memory_of_the_queue():
    digests = [sha(str(i)) for i in range(37)]
    wide, narrow = merkle.Shape(), merkle.Shape(limit=2)
    log = wide.forward(digests, 37)
    assert narrow.forward(digests, 37) == log and log[-1] == tree(digests)[-1][0]
    assert narrow.backward(log, 37, 37, "") == wide.backward(log, 37, 37, "")


def test_wider_runs():
    shape = merkle.Shape(run=3)
    digests = [sha(str(i)) for i in range(11)]
    log = shape.forward(digests, 11)
    paths = shape.backward(log, 11, 11, "")
    assert all(merkle.fold(d, p) == log[-1] for d, p in zip(digests, paths))
