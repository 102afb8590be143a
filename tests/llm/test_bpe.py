from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from basketry.llm import bpe

VOCAB = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(VOCAB)
ODD = [
    None, "", " ", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "ab ab  \n\n q", "日本語テキスト😀😀 ça va",
    "\x00\x01 ​　 z", " " * 300 + "a", "thntblere" * 60, "don't I'LL we've", "same", "same",
]


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    back = LIB.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_matches_the_library_on_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, IDS string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(df, VOCAB).collect()}
    assert got == {i: expected(t) for i, t in enumerate(ODD)}


def test_encode_replaces_a_clashing_column_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "a b", 7, None)], "doc_id long, text string, IDS int, `a.b` string")
    out = bpe.decode(bpe.encode(df, VOCAB), VOCAB)
    assert out.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    assert out.collect()[0].decoded == "a b"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(df, VOCAB).collect() == []


def test_random_strings_and_both_merge_loops():
    rng, mine = random.Random(1), bpe.ByteBpe(VOCAB)
    letters = [*" \n\t\r\x1c\x1f\x85\xa0 ​　ab'sßéŠ1²½٣,.!<|>_́", "ing", " the", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        ids = mine.encode(text)
        assert ids == LIB.encode(text, add_special_tokens=False).ids
        assert mine.decode(ids) == LIB.decode(ids, skip_special_tokens=False)
        if text:
            assert mine.merge_short(text.encode()) == mine.merge_long(text.encode())


def test_ids_cut_inside_a_character_decode_as_the_library():
    ids = LIB.encode("😀é", add_special_tokens=False).ids
    for cut in (ids[:1], ids[1:], ids[::-1]):
        assert bpe.ByteBpe(VOCAB).decode(cut) == LIB.decode(cut, skip_special_tokens=False)


def test_an_unknown_id_raises():
    with pytest.raises(IndexError):
        bpe.ByteBpe(VOCAB).decode([10**6])
