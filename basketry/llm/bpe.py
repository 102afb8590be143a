"""Byte-level BPE encoding and decoding.

A text is cut into words by the vocabulary's split pattern.  A short word is
merged over a *contiguous rank array*: ``ends`` holds the part boundaries,
``ranks[i]`` the merge rank of parts i and i+1.  Each step scans for the
smallest rank (the leftmost of equals), deletes the boundary between its two
parts and refreshes the ranks of the two neighbours.  The scan makes that
quadratic, so words over ``SHORT`` bytes use a heap over linked parts, which
takes the same merges in the same order.

No word holds a space before a visible character, except as its first byte.
So a text may be cut before each such space, and every cut piece is encoded
once per Python worker: dictionaries of at most ``CACHE_WORDS`` pieces and
words, the least recent half of which goes when they are full, keep their ids
as packed 32-bit integers.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import Recent, held, quoted

#: Bytes up to which a word is merged by scanning its rank array.
SHORT = 96
#: Words (and their ids) that a Python worker keeps at most.
CACHE_WORDS = 400_000
NO_RANK = 1 << 60
#: Split pattern of the byte-level vocabularies (a fixed value), with
#: ``\s`` spelled out as Unicode's white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabulary files write for bytes:
    printable Latin-1 characters stand for themselves, the other bytes for
    the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """One vocabulary: ``encode`` text to ids, ``decode`` ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # One merge makes each token, so the bytes of a merged part name its rank.
        self.ranks = {raw(a) + raw(b): r for r, (a, b) in enumerate(pairs)}
        if len(self.ranks) != len(pairs):
            raise ValueError("two merges of this vocabulary make the same token")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.words = regex.compile(SPLIT)
        longest = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        get = self.ranks.get
        self.of_two = [[get(bytes((x, y)), NO_RANK) for y in range(256)] for x in range(256)]
        self.cache, self.pieces = _Words(self), _Pieces(self)

    def merge_short(self, word: bytes) -> tuple[int, ...]:
        """The contiguous rank array."""
        ends = list(range(len(word) + 1))
        rank = self.ranks.get
        of_two = self.of_two
        ranks = [of_two[x][y] for x, y in zip(word, word[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            del ends[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(word[ends[i] : ends[i + 2]], NO_RANK)
            if i:
                ranks[i - 1] = rank(word[ends[i - 1] : ends[i + 1]], NO_RANK)
        ids = self.ids
        return tuple([ids[word[a:b]] for a, b in zip(ends, ends[1:])])

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for a long word: a heap of (rank, start)."""
        n, rank = len(word), self.ranks.get
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            if not alive[a] or end[a] != mid or mid >= n or end[mid] != stop:
                continue
            alive[mid], end[a] = 0, stop
            if stop < n:
                left[stop] = a
                if (r := rank(word[a : end[stop]])) is not None:
                    heapq.heappush(heap, (r, a, stop, end[stop]))
            if (p := left[a]) >= 0 and (r := rank(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, a, stop))
        out, a = [], 0
        while a < n:
            out.append(self.ids[word[a : end[a]]])
            a = end[a]
        return tuple(out)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers of this machine."""
        if self.special is None or not any(s in text for s in self.added):
            return self._plain(text)
        added = self.added
        return b"".join(pack(added[p]) if p in added else self._plain(p) for p in self.special.split(text))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if any(not p or p[0].isspace() for p in rest):  # a space before white space is no place to cut
            return b"".join(map(self.cache.__getitem__, self.words.findall(text)))
        return b"".join(map(self.pieces.__getitem__, [first, *[" " + p for p in rest]]))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf8", "replace")


def pack(*ids: int) -> bytes:
    return array("i", ids).tobytes()


class _Words(Recent):
    def __init__(self, bpe: ByteBpe):
        super().__init__(CACHE_WORDS)
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            raw = word.encode()
            if len(raw) > SHORT:  # long words are rare and would fill the memory
                return pack(*self.bpe.merge_long(raw))
            ids = pack(*self.bpe.merge_short(raw))
        return self.keep(word, ids)


class _Pieces(Recent):
    def __init__(self, bpe: ByteBpe):
        super().__init__(CACHE_WORDS)
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = b"".join(map(self.bpe.cache.__getitem__, self.bpe.words.findall(piece)))
            if len(piece) > SHORT or "\n" in piece:
                return ids
        return self.keep(piece, ids)


def vocabulary(path: str) -> ByteBpe:
    """Loaded once in each Python worker."""
    return held(("bpe", path), lambda: ByteBpe(path))


def _mapped(df: DataFrame, source: str, targets: dict[str, T.DataType], work) -> DataFrame:
    """``df`` with the columns ``targets`` made from column ``source`` by
    ``work(values) -> Arrow arrays`` on Arrow batches; the other columns pass
    through.  A column of a target's name, in any case, is replaced."""
    new = {t.lower() for t in targets}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    kinds = [*(f.dataType for f in keep), *targets.values()]
    names = [f"c{i}" for i in range(len(kinds))]
    # a source that stays is sent once
    stays = [f.name for f in keep]
    at, own = (stays.index(source), []) if source in stays else (len(keep), [quoted(source).alias("src")])
    inner = df.select(*[quoted(f.name).alias(n) for f, n in zip(keep, names)], *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *work(b.column(at))], names=names)

    flat = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return inner.mapInArrow(run, flat).toDF(*[f.name for f in keep], *targets)


def _encoded(bpe: ByteBpe, texts: pa.Array) -> pa.ListArray:
    packed = [bpe.packed(v.as_py() or "") for v in texts]
    ends = np.cumsum([0, *map(len, packed)]) // 4
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _decoded(bpe: ByteBpe, ids: pa.ListArray) -> pa.Array:
    flat = ids.values.to_numpy(zero_copy_only=False)
    ends, null = ids.offsets.to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    cuts = zip(ends[:-1].tolist(), ends[1:].tolist(), null.tolist())
    return pa.array([bpe.decode([] if gone else flat[a:b].tolist()) for a, b, gone in cuts], pa.string())


def encode(df: DataFrame, vocab: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int), the byte-level BPE ids of ``text``.

    Every row stays, in any number of copies; a null text counts as empty and
    gives an empty array.  Strings of added tokens inside a text become their
    ids, as the tokenizer file's own library does.  Other columns pass
    through untouched; one named as ``ids`` is replaced.
    """
    return _mapped(df, text, {ids: T.ArrayType(T.IntegerType())}, lambda v: [_encoded(vocabulary(vocab), v)])


def decode(df: DataFrame, vocab: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the string that the ids stand for, added tokens
    included.  Null or empty ids give an empty string; bytes that are not
    UTF-8 become U+FFFD.  Ids outside the vocabulary raise IndexError."""
    return _mapped(df, ids, {text: T.StringType()}, lambda v: [_decoded(vocabulary(vocab), v)])


def encode_decode(df: DataFrame, vocab: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: the ids are decoded where they
    were made, in the same Python worker."""

    def work(texts: pa.Array) -> list[pa.Array]:
        made = _encoded(vocabulary(vocab), texts)
        return [made, _decoded(vocabulary(vocab), made)]

    return _mapped(df, text, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, work)


def round_trip(df: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined
    by commas) and decoded_sha256, from the real encoder and decoder."""
    docs = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return encode_decode(docs, vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
