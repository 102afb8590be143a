"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every document gets a few plain counts and a score: the mean, over its
n-grams, of log p_target / p_raw.  Both are multinomials over ``BUCKETS``
hashed n-grams (one and two neighbouring pieces; a piece is a run of letters,
of digits, or of other signs).  ``raw`` counts all n-grams of all documents.
``target`` counts those of trusted documents: labelled of good quality and
not toxic.  Toxic documents of good quality are neither good nor bad: the
score is one of quality, and they are judged by it like any other.  The target
counts and the threshold are learned from every labelled document.  The rules
and scores of all documents are written once (a narrow row each); the
threshold is learned from that table and then decides its rows.

Ratios are whole millionths, so a document's sum does not depend on any
order, and the threshold decides each document alike wherever it is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.lineage import kept as persisted
from basketry.llm.common import WS, quoted, shared_path, written

#: Hashed n-grams; bounds what reaches the driver and the ratios' literal.
BUCKETS = 10_000
#: Words of a window that is looked up in its own text.
WINDOW = 8
SCALE = 1_000_000
#: The share of good documents that a threshold loses counts so many times the
#: share of bad ones that it catches.
GOOD_COUNTS = 10
PIECE = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.  A column that a lambda
    refers to may be inlined into it by the optimizer, and would then be
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(f"[^{WS}]")))
    return F.size(lines) - F.size(F.array_distinct(lines))


def _span(n: Column) -> Column:
    """0 .. n - 1, empty for n of 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _pairs(h: Column, step: int) -> Column:
    """For each place the hash of its value and the one ``step`` further on;
    the last ``step`` places, which have none, follow with other hashes."""
    return F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def with_rules(df: DataFrame, words: str = "words") -> DataFrame:
    """Add ``n_repeat_words``: words in windows of 8 that the text has twice
    or more, the first included.  Windows are compared by a 64-bit hash of
    their words' hashes, and only texts in which two agree are sorted."""
    def windows(h: Column) -> Column:
        """Hashes of 2, then 4, then 8 neighbours, each from two of the ones before."""
        last = lambda four: F.slice(_pairs(four, 4), 1, F.greatest(F.size(four) - (WINDOW - 1), F.lit(0)))
        return let(_pairs(h, 1), lambda two: let(_pairs(two, 2), last))

    def places(w: Column) -> Column:
        """Where the windows begin that occur twice or more, in order."""
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, j, p: F.coalesce(F.get(s, j)["h"] == p["h"], F.lit(False))
        twice = let(pairs, lambda s: F.filter(s, lambda p, j: same(s, j - 1, p) | same(s, j + 1, p)))
        found = F.sort_array(F.transform(twice, lambda p: p["i"]))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), found).otherwise(F.array().cast("array<int>"))

    at = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), places)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end"))
    return df.withColumn("n_repeat_words", F.aggregate(at, start, step, lambda a: a["n"]).cast("long"))


def base_failed(words: str = "words") -> Column:
    """Under 20 words, or over 30 % of them repeated."""
    return (F.size(words) < 20) | (100 * F.col("n_repeat_words") > 30 * F.size(words))


def pieces_of(text: Column) -> Column:
    """The hashes of a text's pieces, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PIECE})"), 1), lambda p: F.xxhash64(p))


def _buckets(h: Column, i: Column) -> list[Column]:
    """The n-grams that end at piece i: the piece, and the pair (null for the first)."""
    pair = F.xxhash64(F.get(h, i - 1), F.get(h, i))
    return [F.pmod(F.get(h, i), F.lit(BUCKETS)), F.when(i > 0, F.pmod(pair, F.lit(BUCKETS)))]


def grams(hashes: str) -> Column:
    """All hashed n-grams of a text, for counting."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS))
    two = lambda h: F.slice(_pairs(h, 1), 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return let(F.col(hashes), lambda h: F.concat(F.transform(h, bucket), F.transform(two(h), bucket)))


def ratio_sum(hashes: str, ratios: list[int]) -> Column:
    """The sum of the n-grams' log ratios, in millionths."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<bigint>")

    def total(h: Column) -> Column:
        def step(so_far: Column, i: Column) -> Column:
            one, two = _buckets(h, i)
            return so_far + F.get(table, one.cast("int")) + F.coalesce(F.get(table, two.cast("int")), F.lit(0))

        return F.aggregate(_span(F.size(h)), F.lit(0).cast("bigint"), step)

    return let(F.col(hashes), total)


def labelled(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(_id, good) of every labelled document.  Good: quality 1
    and not toxic by all its rows; bad: quality 0.  Toxic ones of quality 1 are of
    no class; rows without an id or a quality do not count."""
    rows = labels.select(quoted(doc_id).alias("_id"), F.col("quality"), F.col("toxic")).where("_id is not null and quality is not null")
    one = rows.groupBy("_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return one.where("q = 0 or x = 0").select("_id", (F.col("q") == 1).alias("good"))


def log_ratios(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """The log ratio of each bucket, in millionths.  Labels grow with the
    documents, so they are not broadcast: texts are dealt by id to a hash join,
    without a sort, and cut into pieces behind it."""
    docs = df.select(quoted(doc_id).alias("_d"), quoted(text).alias("t"))
    marked = docs.join(labelled(labels, doc_id).hint("shuffle_hash"), F.col("_d") == F.col("_id"), "left")
    hashed = marked.select(pieces_of(F.col("t")).alias("h"), F.coalesce("good", F.lit(False)).alias("good"))
    counted = hashed.select("good", F.explode(grams("h")).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
    raw, target = [1] * BUCKETS, [1] * BUCKETS  # one more for each, so that none is zero
    for r in counted.collect():
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    all_raw, all_target = sum(raw), sum(target)
    return [round(SCALE * math.log((t / all_target) / (r / all_raw))) for t, r in zip(target, raw)]


def least_score(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> float:
    """The threshold: the best one for those labelled documents of a
    ``measured`` table that pass the plain rules."""
    rows = measured.where(~F.col("base_failed") & F.col("score").isNotNull()).select("doc_id", F.floor(F.col("score") * 1000).alias("bin"))
    seen = rows.join(labelled(labels, doc_id), F.col("doc_id") == F.col("_id"))
    bins = seen.groupBy("bin").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    return threshold([(r["bin"] / 1000, r["g"], r["b"]) for r in bins.collect()])


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[list[int], float]:
    """The log ratio of each bucket, in millionths, and the threshold."""
    ratios = log_ratios(df, labels, doc_id, text)
    return ratios, least_score(measured(df, ratios, doc_id, text), labels, doc_id)


def threshold(bins: list[tuple[float, int, int]]) -> float:
    """bins: (lower edge, good, bad); a document is kept from the threshold
    on.  The most bad ones caught less ``GOOD_COUNTS`` times the good ones
    lost; of equals the lowest; without both classes none."""
    good, bad = sum(g for _, g, _ in bins), sum(b for _, _, b in bins)
    if not good or not bad:
        return -math.inf
    best, at, lost, caught = 0.0, -math.inf, 0, 0
    edges = sorted(bins)
    for i, (_, g, b) in enumerate(edges):
        lost, caught = lost + g, caught + b
        gain = caught / bad - GOOD_COUNTS * lost / good
        if i + 1 < len(edges) and gain > best:
            # Half way to the next score seen.
            best, at = gain, (edges[i][0] + 0.001 + edges[i + 1][0]) / 2
    return at


def score(hashes: str, ratios: list[int]) -> Column:
    """Mean log ratio of an n-gram; null for a text without any."""
    n = (2 * F.size(hashes) - 1).cast("double")
    return F.when(F.size(hashes) > 0, ratio_sum(hashes, ratios) / (n * SCALE))


def measured(df: DataFrame, ratios: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, the counts, base_failed and the score,
    computed once and written (kept, where no folder is shared)."""
    t = F.coalesce(quoted(text), F.lit(""))
    rows = df.select(
        quoted(doc_id).alias("doc_id"),
        words_of(t).alias("words"),
        pieces_of(t).alias("hashes"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        n_dup_lines(t).cast("long").alias("n_dup_lines"),
    )
    done = with_rules(rows).withColumn("n_words", F.size("words").cast("long"))
    done = done.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    done = done.withColumn("base_failed", base_failed()).withColumn("score", score("hashes", ratios))
    done = done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    return written(done, "quality") if shared_path(df.sparkSession, "quality") else persisted(done)


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score, threshold.

    ``base_failed``: under 20 words, or over 30 % of the words repeated.
    ``kept``: not failed, and a score of the threshold or more; -infinity
    (labels of one class only, or none) keeps all that did not fail.  A null
    text has no words and fails.  Repeated rows are judged each; other
    columns are not read."""
    done = measured(df, log_ratios(df, labels, doc_id, text), doc_id, text)
    done = done.withColumn("threshold", F.lit(float(least_score(done, labels, doc_id))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    return done.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold"
    )
