from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import wavelet as W
from basketry.llm.common import Recent

VOCAB = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(VOCAB)


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n,width", [(0, 3), (1, 1), (7, 3), (513, 16), (5000, 16)])
def test_matrix_against_a_list(n, width):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, min(1 << width, 50), n) if n != 513 else rng.integers(0, 1 << width, n)
    doc_ids, ends, m = W.unpack(W.pack(np.array([3]), np.array([n]), ids.astype(np.uint32), width))
    assert doc_ids.tolist() == [3] and ends.tolist() == [n]
    assert m.all().tolist() == ids.tolist()
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert m.access(i) == ids[i]
        v = int(ids[i])
        places = np.flatnonzero(ids == v).tolist()
        assert m.count(v) == len(places) and m.count(v, i) == sum(p < i for p in places)
        for k in {0, len(places) // 2, len(places) - 1}:
            assert m.find(v, k) == places[k]
        assert m.find(v, len(places)) == -1
    assert m.count(1 << width) == 0 and m.find((1 << width) - 1, n) == -1
    with pytest.raises(IndexError):
        m.access(n)


def test_ids_are_the_library_s():
    rng, mine = random.Random(7), W.Encoder(VOCAB)
    letters = [*" \n\t\x1c\x1f\x85\xa0 ​　aAbB'ßÉéŠİſΣς1²½٣,.!<|>_́̈가각ㄱ", "ing", " the", "<|endoftext|>", "<|startoftext|>"]
    texts = ["", None, "  ", "x" * 5000, "The The the THE", "<|ENDOFTEXT|> A", "J\u030c T\u0308. W\u030aX", "a., b.. c,. d.e ,f é, é. it's. I'LL, x.\n", "Ab.", "a.\x1f,"] + ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["éöüß ñandú şehir дом ΣΑΣ σας ſtein ﬁne Ǆ ǆ ﬀ", "가각 각 k\u0307", "ªº ʰa ⅷ Ⅷ"]
    texts += ["a!! b?! (c) d_e [f]* 12ab34 x#$%y", "é!? ß... ñ)* É! ö'", "a\x01b \x02 \x00!", "can't! it's, 'tis"]
    for part in (texts, texts[:1], texts[::-1]):
        ids, ends = mine.packed(part, 7)
        assert len(ends) == len(part)
        for got, text in zip(np.split(ids, ends)[:-1], part):
            assert got.tolist() == [*lib_ids(text), 7], repr(text)
    assert [len(x) for x in mine.packed([], 7)] == [0, 0]


def test_files_in_order(spark):
    rng = random.Random(8)
    rows = [(i * 3, rng.choice([None, "", "Hello World", "a b c " * rng.randint(1, 400)]), 5) for i in range(200)]
    rows += [(30, "twice", 1), (30, "twice", 1), (31, "long " * 60000, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, START int")
    got = [tuple(r) for r in W.store_and_read(df, VOCAB).orderBy("start").collect()]
    start, want = 0, []
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for doc, text, _ in sorted(rows, key=lambda r: (r[0], hashes[r[1]])):
        ids = np.array([*lib_ids(text), 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_one_id_with_a_third_of_the_rows_is_many_files(spark, tmp_path):
    rows = [(5 if i % 3 else i, f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = W.write_shards(df, VOCAB, 1, str(tmp_path))
    docs = files.collect()
    assert sum(r.docs for r in docs) == 900 and max(r.docs for r in docs) < 400
    read = W.read_shards(files, str(tmp_path)).orderBy("start").collect()
    ids = [r.doc_id for r in read]
    assert ids == sorted(d for d, _ in rows) and sum(1 for r in docs if 5 in W.unpack(W.load(str(tmp_path), r.name))[0]) > 2


def test_starts_over_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "RUN_FILES", 2)
    rows = [(i, "a b c " * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    read = W.read_shards(W.write_shards(df, VOCAB, 1, str(tmp_path)), str(tmp_path)).orderBy("doc_id").collect()
    assert [r.start for r in read] == [sum(x.n_tokens for x in read[:i]) for i in range(60)]


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b")], "doc_id long, text string")
    got = [(r.doc_id, r.start) for r in W.store_and_read(df, VOCAB).orderBy("start").collect()]
    assert [d for d, _ in got] == [None, 2] and got[0][1] == 0
    assert W.store_and_read(df.limit(0), VOCAB).collect() == []


def test_a_broken_file_is_told():
    raw = W.pack(np.array([1]), np.array([2]), np.array([5, 6], np.uint32), 3)
    with pytest.raises(ValueError):
        W.unpack(b"X" + raw[1:])
    with pytest.raises((ValueError, zlib.error)):
        W.unpack(raw[:-12])


def test_pieces_are_cut_from_one_buffer():
    values = ["", "a", "\n", "größe", "x" * 300, "end"]
    array = pa.array([v.encode() for v in values], pa.large_binary())
    for a in range(len(values) + 1):
        for z in range(a, len(values) + 1):
            assert W.cut(array.slice(a, z - a)) == array.slice(a, z - a).to_pylist()


def test_a_full_table_gives_the_same_ids():
    mine, full = W.Encoder(VOCAB), W.Encoder(VOCAB)
    full.seen, full.runs = Recent(6), Recent(4)
    texts = ["one two, three one two three!", None, "four two one ... größe, größe 12.5 it's", "y" * 70 + " one, y " + "y" * 70]
    for block in (texts, texts[::-1], texts):
        for a, b in zip(mine.packed(block, 1), full.packed(block, 1)):
            assert a.tolist() == b.tolist()


def test_a_word_that_is_a_piece_by_itself_is_kept_once():
    mine = W.Encoder(VOCAB)
    mine.packed(["two words"], 1)
    assert not mine.runs and set(mine.seen) == {b"two", b"words"}
