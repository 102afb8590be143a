from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from basketry.llm import phrases


def brute(rows, least, top=2000, absorb=80):
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= absorb * a for b in longer):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n, -s))
    return sorted(out)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "x", "日本", "a b", "rare"] + [f"w{i}" for i in range(40)]
    weights = [30, 5, 25, 20, 20, 15, 9, 9, 5, 3, 1] + [0.7] * 40
    marks = [" ", " ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "! ", " : "]
    rows = []
    for i in range(n):
        t = "".join(rng.choices(words, weights)[0] + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((t, rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), ("new york city of the " * 3000, "de"), (". , ;", "fr"), ("one", "fr")] + rows[:3]


@pytest.mark.parametrize("hot", [40, 5000])
@pytest.mark.parametrize("least", [2, 30])
def test_against_brute_force(spark, hot, least):
    rows = texts(150)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, w1 int, N string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, sizes=phrases.Sizes(hot=hot, block=3000)).collect())
    assert got == brute(rows, least)


def test_few_and_ties(spark):
    rows = texts(80, seed=4)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(df, 3, top=7).collect())
    assert got == brute(rows, 3, top=7)


def test_a_filter_that_lets_everything_through(spark):
    rows = texts(60, seed=5)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(df, 4, sizes=phrases.Sizes(bits=64)).collect()) == brute(rows, 4)


def test_nothing_frequent_and_empty_table(spark):
    df = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    assert phrases.collocations(df).collect() == [] and phrases.collocations(df.limit(0)).collect() == []


class Run:
    """Stands for a DataFrame: runs a task on given batches."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return pa.Table.from_batches(run(iter(self.batches)))


@pytest.mark.parametrize("hot", [set(), {("en", "a", "b"), ("en", "b", "a"), ("de", "a", "w1"), ("en", "no", "b")}])
def test_packed_windows_are_the_windows(hot):
    class Bits:
        value = np.full(phrases.Sizes().bits // 8, 255, np.uint8)

    words = [f"w{i}" for i in range(4000)] * 2 + ["a", "b"] * 50 + ["a", "b", "w1", "a", "b", "w2"]
    docs = Run(pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(words)])], names=["lang", "text"]))
    rows = phrases.windows(docs, Bits(), hot, 64).to_pylist()
    got, where = Counter(), {}
    for r in rows:
        fields = zstandard.decompress(r["fields"]).decode().split(" ")
        for i in range(0, len(fields), 5):
            key = tuple(w or None for w in fields[i : i + 4])
            got[key] += int(fields[i + 4])
            where.setdefault(key[:2], set()).add(r["bucket"])
    want = Counter(tuple((words[i : i + 4] + [None] * 3)[:4]) for i in range(len(words)))
    want[(None,) * 4] = 0
    assert got == want and all(0 <= r["bucket"] < 64 for r in rows)
    # a pair is in one bucket, a hot one in several
    assert {p for p, b in where.items() if len(b) > 1} == {h[1:] for h in hot if h[1:] in where and len({k[2] for k in want if k[:2] == h[1:]}) > 1}
    # what comes out of a bucket is shortened, but no count is lost
    for lang, bucket in {(r["lang"], r["bucket"]) for r in rows}:
        own = [r["fields"] for r in rows if (r["lang"], r["bucket"]) == (lang, bucket)]
        out = phrases.unpacked(lang, own * 2, hot, 3).to_pylist()
        assert len({tuple(r[w] for w in phrases.WORDS) for r in out}) == len(out)
        total = sum(int(x) for f in own for x in zstandard.decompress(f).decode().split(" ")[4::5])
        assert sum(r["n"] for r in out) == 2 * total


@pytest.mark.parametrize("bucket", [1, 30, 10**6])
def test_the_number_of_buckets_changes_nothing(spark, bucket):
    rows = texts(60, seed=6)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    got = sorted(tuple(r) for r in phrases.collocations(df, 3, sizes=phrases.Sizes(bucket=bucket, block=2000)).collect())
    assert got == brute(rows, 3)
