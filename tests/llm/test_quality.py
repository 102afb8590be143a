from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import quality as Q


def slow_rules(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def odd_texts():
    rng = random.Random(2)
    texts = [None, "", "  \n", "a " * 19, "a " * 20, "one two\n\none two\n \n", "w\x0bx\x0cy\rz\x1cq\x85 p", "😀 é " * 12, "a b c d e f g h " * 3, "x" * 100000, "lorem ipsum dolor " * 9000]
    for _ in range(60):
        texts.append("".join(rng.choices(["a", "b", "c ", " ", "\n", "a b c d e f g h ", "%", "dd é\n"], k=rng.randint(0, 120))))
    return texts


def test_rules_against_plain_loops(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, words int, SCORE int")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    rows = Q.judge(df, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in RULES) == slow_rules(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed) and r.threshold == -math.inf


def gram_words(text):
    return re.findall(r"[^\W\d_]+|\d+|[^\w\x20\x09-\x0d]+", text or "")


def test_ratio_against_counts(spark):
    rng = random.Random(4)
    good, bad = [f"w{chr(97 + i)}" for i in range(20)], [f"W{chr(97 + i)} %" for i in range(20)]
    good, bad = [re.sub(r"\d", "", g) for g in good], bad
    rows = [(i, " ".join(rng.choices(good if i % 4 else bad, k=40))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120, 2)] + [(1, 1, 1), (3, None, 0), (None, 1, 0)], "doc_id long, quality long, toxic long")
    ratios, least = Q.learn(df, labels)

    def hashes(text):
        h = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(gram_words(text))], "i int, x string").orderBy("i").select(F.xxhash64("x")).collect()]
        two = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:]))], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect()]
        return [x % Q.BUCKETS for x in h + two]

    table = {d: hashes(t) for d, t in rows}
    raw, target = Counter(), Counter()
    for d, g in table.items():
        raw.update(g)
        if d % 4 == 2:  # the labelled good ones
            target.update(g)
    n_raw, n_target = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    want = [round(Q.SCALE * math.log(((target[b] + 1) / n_target) / ((raw[b] + 1) / n_raw))) for b in range(Q.BUCKETS)]
    assert ratios == want
    out = {r.doc_id: r for r in Q.judge(df, labels).collect()}
    for d, g in table.items():
        assert out[d].score == pytest.approx(sum(ratios[b] for b in g) / len(g) / Q.SCALE)
        assert out[d].kept == (not out[d].base_failed and out[d].score >= least) == (d % 4 > 0)


def test_threshold():
    assert Q.threshold([]) == Q.threshold([(0.0, 3, 0)]) == Q.threshold([(0.0, 0, 3)]) == -math.inf
    assert Q.threshold([(-2.0, 0, 5), (-1.0, 0, 5), (1.0, 7, 0)]) == pytest.approx((-1.0 + 0.001 + 1.0) / 2)
    assert Q.threshold([(-2.0, 5, 0), (1.0, 0, 7)]) == -math.inf  # nothing is worth the good ones


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b " * 30)] * 3 + [(None, "c d e " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 2, "doc_id long, quality long, toxic long")
    assert Q.judge(df, labels).count() == 4
    assert Q.judge(df.limit(0), labels).collect() == []


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    plan = Q.judge(df, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.judge(docs, labels).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_every_labelled_document_counts(spark):
    """More labelled documents than the 20,000 that were once sampled: with all
    of them good, target and raw counts agree; the bad ones all count."""
    n = 20_100
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    good = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("quality"), F.lit(0).cast("long").alias("toxic"))
    assert set(Q.log_ratios(df, good)) == {0}
    assert Q.labelled(good).count() == n
