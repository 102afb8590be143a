from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from basketry.llm import langid

FILE = P.path("piece_bpe_32k.model")
PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "c"]


def all_cuts(text, p):
    """Every segmentation of the text into pieces, with its probability."""
    if not text:
        return [((), 1.0)]
    out = []
    for n in range(1, len(text) + 1):
        q = p.get(text[:n], langid.UNKNOWN if n == 1 else None)
        if q is not None:
            out += [((text[:n], *rest), q * r) for rest, r in all_cuts(text[n:], p)]
    return out


def test_forward_sums_all_segmentations():
    rng = random.Random(5)
    probs = [(rng.random(), rng.random()) for _ in PIECES]
    scorer = langid.Scorer(langid.Model(["x", "y"], PIECES, probs))
    for _ in range(60):
        word = "".join(rng.choices("abcz", k=rng.randint(1, 9)))
        for lang in (0, 1):
            p = {w: q[lang] for w, q in zip(PIECES, probs)}
            total = sum(q for _, q in all_cuts(langid.START + word, p))
            assert scorer.word(word)[lang] == pytest.approx(math.log(total))
            assert scorer.words(["a", word])[1][lang] == pytest.approx(math.log(total))


def test_expected_counts():
    rng = random.Random(6)
    p = [rng.random() for _ in PIECES]
    by = dict(zip(PIECES, p))
    for word in ("ababa", "aab", "zab", "cc"):
        got: Counter = Counter()
        langid.expected(word, langid.trie_of(PIECES), p, 2.0, got)
        cuts, want = all_cuts(langid.START + word, by), Counter()
        total = sum(q for _, q in cuts)
        for pieces, q in cuts:
            for x in pieces:
                if x in by:
                    want[PIECES.index(x)] += 2.0 * q / total
        assert {k: pytest.approx(v) for k, v in want.items()} == dict(got)


def test_long_words_do_not_underflow():
    probs = [(0.01, 0.02)] * len(PIECES)
    scorer = langid.Scorer(langid.Model(["x", "y"], PIECES, probs))
    one, many = scorer.word("z" * 10), scorer.word("z" * 5000)
    step = math.log(langid.UNKNOWN)
    assert scorer.words(["z" * 40, "z" * 10])[1] == pytest.approx(one)
    assert many == pytest.approx([x + 4990 * step for x in one])


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    got = langid.identify(df, FILE).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(i, t, g, "x") for i, (t, g) in enumerate([("the house and the dog", "en"), ("la maison et le chien", "fr")] * 8)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 !! …", None, "x"), (103, "the dog " * 20000, None, "x"), (None, "le chien", "fr", "x"), (0, "the house and the dog", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string")
    got = langid.identify(df, FILE).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: (r.lang_pred, r.held_out) for r in got}
    assert [pred[i][0] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "fr"] and pred[None][1] is False
    kept = langid.keep_known(df, FILE)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df, FILE).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0), FILE).collect() == []


def test_tables_are_bounded_by_bytes():
    probs = [(0.01, 0.02)] * len(PIECES)
    model = langid.Model(["x", "y"], PIECES, probs)
    scorer = langid.Scorer(model)
    assert scorer.words_seen.size * (8 * 3 + 300) <= langid.CACHE_BYTES
    scorer.words_seen.size = scorer.pieces_seen.size = 50
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcz", k=rng.randint(1, 6))) for _ in range(60)) + "!" for _ in range(40)]
    whole = langid.Scorer(model)
    for t in texts:
        assert scorer.predict(t) == whole.predict(t)
        assert len(scorer.words_seen) + len(scorer.words_seen.old) <= 400


def test_what_fits_no_language_goes(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(10)
    odd = [(10**6 + i, " ".join("".join(rng.choices("qxzjvkwpyf", k=rng.randint(6, 12))) for _ in range(80)), None) for i in range(20)]
    odd += [(10**6 + 100, "фвыа олдж йцук ячсм " * 30, None), (10**6 + 101, "12 !!", "en")]
    both = df.unionByName(spark.createDataFrame(odd, df.schema)).withColumn("_lang_pred", F.lit("kept"))
    kept = langid.keep_known(both, FILE)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == both.columns and not any(i >= 10**6 for i in ids)
    assert len(ids) >= 0.98 * df.count()
