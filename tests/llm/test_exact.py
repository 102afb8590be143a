from __future__ import annotations

import hashlib
import random
import re

import pytest

from basketry.llm import exact


def brute(rows):
    """(doc_id, text) rows: doc_id, keep_id, group_size, kept, sha256."""
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    groups: dict[str, list[int]] = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        best = min(groups[norm[i]], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((d, rows[best][0], len(groups[norm[i]]), best == i, hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


def rows_of(df, **kw):
    return [tuple(r) for r in exact.exact_duplicates(df, **kw).collect()]


def some_rows(n=400):
    rng = random.Random(3)
    words = ["a", "b", " ", "\n", "\x0b", "é", "x y", " \t"]
    rows = [(i, "".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(n)]
    rows += [(900 + i, "copy " * 3 + " " * (i % 3)) for i in range(150)]
    return rows + [(2000, None), (2001, ""), (2002, " \r\x0c"), (2003, "long " * 60000), (2004, "long" * 60000), (2005, " ")]


def test_against_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(rows_of(df)) == sorted(brute(rows))


def test_contents_are_compared_where_digests_collide(spark):
    rows = some_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda content: str(len(content) % 2)
    got = sorted(r[:4] for r in rows_of(df, digest=weak, salts=3))
    assert got == sorted(r[:4] for r in brute(rows))


def test_blocks_end_and_go_on(spark, monkeypatch):
    block = exact.Block(exact.sha256, lambda c: c, 5 << 40)
    monkeypatch.setattr(exact, "BLOCK_ROWS", 3)
    assert [block.add(i, "same") for i in range(3)] == [False, False, True]
    first = block.flush().to_pylist()
    assert [r["grp"] for r in first] == [5 << 40] * 3 and [r["n"] for r in first] == [3, None, None]
    assert not block.add(9, "same") and block.flush().to_pylist()[0]["grp"] == (5 << 40) + 1


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(1, "a b", 0, "x", 1), (1, "a b", 0, "x", 1), (1, "ab", 0, "x", 1), (1, "c", 0, "x", 1), (None, "c ", 0, "x", 1), (None, None, 0, "x", 1), (None, "", 0, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int, digest string, n int")
    got = exact.hash_table(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
    seen = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str)
    want = [(1, 1, 3, True), (1, 1, 3, False), (1, 1, 3, False), (1, None, 2, False), (None, None, 2, True), (None, None, 2, True), (None, None, 2, False)]
    assert seen == sorted(want, key=str)
    assert exact.hash_table(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 16])
def test_one_huge_group(spark, parts):
    rows = [(i, "the same text" + " " * (i == 77)) for i in range(3000)]
    got = rows_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    assert {r[1:3] for r in got} == {(77, 3000)} and [r[0] for r in got if r[3]] == [77]
