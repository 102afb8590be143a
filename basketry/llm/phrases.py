"""Phrase collocations by top-order marginalisation.

Only windows of the longest order are counted: each word with the three words
that lead it (``windows``), padded where the piece ends.  Every shorter phrase
is a prefix of such windows, so its count is the sum over them, and Spark's
ROLLUP over the four columns gives the counts of all orders at once.

Before ROLLUP, windows are shortened where that cannot change a count of
``least`` or more:

* A word that occurs fewer than ``least`` times in its language is in no
  candidate and in no part of one: the window ends there.  Workers test words
  against a Bloom filter of the frequent ones, of a fixed size; words that it
  lets through by mistake only cost time.
* Windows are dealt to buckets by a hash of their first two words.  There a
  window whose prefix of k words has fewer than ``least`` occurrences ends
  before its k-th word (``shortened``).  The prefix counts are whole, as all
  windows of a pair are in one bucket.  Hot pairs are dealt by the third word
  too; they are never shortened to one word, and their longer prefixes are
  whole as well.  So what one bucket gets is a small fixed share of all windows.

A pair is hot if it is over one in ``Sizes.hot`` of all pairs, counted in the
blocks of text where it is over one in so many.  Pairs of twice that share are
among them, as they are so frequent in some block and lose less than half by
the others; and there are at most ``Sizes.hot``.

Windows are dealt packed: one row for each bucket and block of texts, with the
four words and the count of each different window, sorted and compressed.  The
number of buckets follows from the count of words.
Tasks count equal windows of a block of texts before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import discard, quoted, written

#: Bits of the filter that a word sets.
FILTER_HASHES = 4
ORDER = 4
WORDS = [f"w{i + 1}" for i in range(ORDER)]
NO_LANG = "und"


@dataclass(frozen=True)
class Sizes:
    """Sizes that change no result."""

    #: Bits of the filter of frequent words (8 MB).
    bits: int = 1 << 26
    #: A pair of words is hot if it is over one in so many.
    hot: int = 5_000
    #: Bytes of text whose words or windows are counted together.
    block: int = 12 << 20
    #: Words of the corpus for each bucket.
    bucket: int = 1_000_000


#: Bytes: A-Z in lower case, tab as space, all marks that end a piece as ".".
_MARKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _MARKS, bytes(range(97, 123)) + b" " + b"." * len(_MARKS))


def split_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of the texts as numbers, and the words by number.  Number 0
    ends a piece, and so does each text."""
    flat = b" . ".join([b"", *(t.translate(_FOLD).replace(b".", b" . ") for t in texts), b""])
    # large_binary, as a block can hold one text of any length
    parts = pc.split_pattern(pa.array([flat], pa.large_binary()), b" ").flatten()
    coded = parts.dictionary_encode()
    known = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    new = np.zeros(len(known), np.int32)
    words = [b""]
    for i, w in enumerate(known):
        if w == b"":
            new[i] = -1
        elif w != b".":
            new[i] = len(words)
            words.append(w)
    ids = new[ids]
    return ids[ids >= 0], words


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts (second column) of one language (first column) together, about
    ``most`` bytes at a time over all languages."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            held.setdefault(lang, []).append(t := (text.as_py() or "").encode())
            size += len(t)
            if size >= most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def count_words(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """lang, word, n over all texts; and of the pairs of words, joined by a
    space, those that are hot in a block, with their number in such blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in blocks(batches, sizes.block):
            ids, words = split_words(texts)
            n = np.bincount(ids, minlength=len(words))[1:]
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            pairs, many = np.unique(ids[:-1][both].astype(np.int64) << 32 | ids[1:][both], return_counts=True)
            hot = many * sizes.hot > both.sum()
            found = words[1:] + [words[p >> 32] + b" " + words[p & (1 << 32) - 1] for p in pairs[hot].tolist()]
            n = np.append(n, many[hot])
            cols = [pa.array([lang] * len(n), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "n"])

    local = docs.mapInArrow(run, "lang string, word string, n long")
    return local.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def places(lang: str, words: list[bytes], bits: int) -> np.ndarray:
    """Bits of each word in the filter: one row a word."""
    head = lang.encode() + b" "
    h = np.fromiter((xxhash.xxh64_intdigest(head + w) for w in words), np.uint64, len(words))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(FILTER_HASHES, dtype=np.uint64)) % np.uint64(bits)


def word_filter(frequent: DataFrame, sizes: Sizes) -> np.ndarray:
    """The filter as bytes: what reaches the driver are its non-zero parts, of
    64 bits each, however many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(word.encode())
            for lang, words in by.items():
                at = np.unique(places(lang, words, sizes.bits))
                cols = [pa.array(at >> np.uint64(6), pa.int64()), pa.array((at & np.uint64(63)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "bit"])

    bits = frequent.select("lang", "word").mapInArrow(run, "part long, bit int")
    parts = bits.groupBy("part").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(sizes.bits // 64, np.int64)
    out[parts.column("part").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint8)


def sums(n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the ones before; the first one does."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


PACKED = "lang string, bucket int, fields binary"
#: Numbers of words within a block fit into so many bits.
BITS = 24
#: Fields of a packed window: the words, empty where padded, and the count.
FIELDS = ORDER + 1
HALF = (1 << 32) - 1


def bucket_of(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, hashes: np.ndarray, is_hot: np.ndarray, buckets: int) -> np.ndarray:
    """By the hashes of the first two words, and of the third for hot pairs."""
    mixed = hashes[c1] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[c2] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= np.where(is_hot, hashes[c3] * np.uint64(0x165667B19E3779F9), np.uint64(0))
    return ((mixed >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)


def windows(docs: DataFrame, bits, hot: set[tuple[str, str, str]], buckets: int, sizes: Sizes = Sizes()) -> DataFrame:
    """The padded longest windows of all texts, cut at words that the broadcast
    filter ``bits`` does not know, as each block counts them: a row for each
    bucket with, compressed, the ``FIELDS`` of each different window, parted by
    spaces.  Windows that start with an unknown word keep no word and count all
    the same, in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seal = bits.value, zstandard.ZstdCompressor(level=3).compress
        for lang, texts in blocks(batches, sizes.block):
            ids, words = split_words(texts)
            at = places(lang, words, sizes.bits)
            has = ((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            # 0 ends a window; frequent words are numbered from 1, in order of their bytes
            own = sorted(w for w, keep in zip(words[1:], has[1:].tolist()) if keep)
            rank = {w: i + 1 for i, w in enumerate(own)}
            of = np.array([0, *(rank.get(w, 0) for w in words[1:])], np.int32)
            first = of[ids]
            alone = int(((ids > 0) & (first == 0)).sum())
            cols, lead = [first], first
            for _ in range(ORDER - 1):
                lead = np.append(lead[1:], np.int32(0))
                cols.append(np.where(cols[-1] > 0, lead, 0))
            c1, c2, c3, c4 = (c[first > 0].astype(np.int64) for c in cols)
            del ids, first, lead, cols, at
            pair, rest = c1 << BITS | c2, c3 << BITS | c4
            hots = [rank[a.encode()] << BITS | rank[z.encode()] for g, a, z in hot if g == lang and a.encode() in rank and z.encode() in rank]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in [b"", *own]), np.uint64, len(own) + 1)
            bucket = bucket_of(c1, c2, c3, hashes, np.isin(pair, hots), buckets)
            del c1, c2, c3, c4
            order = np.lexsort((rest, pair, bucket))
            pair, rest, bucket = pair[order], rest[order], bucket[order]
            starts = changes(bucket, pair, rest)
            n = np.diff(np.append(starts, len(pair)))
            pair, rest, bucket = pair[starts], rest[starts], bucket[starts]
            texts_of = pa.array([b"", *own], pa.binary())
            four = [texts_of.take(pa.array(c)) for key in (pair, rest) for c in (key >> BITS, key & (1 << BITS) - 1)]
            lines = pc.binary_join_element_wise(*four, pa.array(n).cast(pa.string()).cast(pa.binary()), b" ")
            heads = changes(bucket)
            rows = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(heads, len(lines))), lines.cast(pa.large_binary())), pa.scalar(b" ", pa.large_binary()))
            packed = [seal(r.as_buffer()) for r in rows]
            empty = seal(b" " * ORDER + str(alone).encode())
            made = [pa.array([lang] * (len(heads) + 1)), pa.array([alone % buckets, *bucket[heads].tolist()], pa.int32()), pa.array([empty, *packed], pa.binary())]
            yield from pa.Table.from_arrays(made, names=["lang", "bucket", "fields"]).to_batches(max_chunksize=1 << 10)

    return docs.mapInArrow(run, PACKED)


def unpacked(lang: str, packed: list[bytes], hot: set[tuple[str, str, str]], least: int) -> pa.Table:
    """The windows of all rows of a language and bucket together, ended where a
    prefix has fewer than ``least`` occurrences: lang, w1..w4, n."""
    load = zstandard.ZstdDecompressor().decompress
    flat = b" ".join([load(p) for p in packed])
    coded = pc.split_pattern(pa.array([flat], pa.large_binary()), b" ").flatten().dictionary_encode()
    del flat
    known = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).reshape(-1, FIELDS)
    counts = np.zeros(len(known), np.int64)
    for c in np.unique(codes[:, ORDER]).tolist():
        counts[c] = int(known[c])
    n = counts[codes[:, ORDER]]
    pad = known.index(b"") if b"" in known else -1
    pair = codes[:, 0].astype(np.int64) << 32 | codes[:, 1]
    rest = codes[:, 2].astype(np.int64) << 32 | codes[:, 3]
    del codes, coded
    order = np.lexsort((rest, pair))
    pair, rest, n = pair[order], rest[order], n[order]
    starts = changes(pair, rest)
    n, pair, rest = sums(n, starts), pair[starts], rest[starts]
    # Totals of the prefixes, on each window.
    twos = changes(pair)
    threes = changes(pair, rest >> 32)
    of_two, of_three = (np.repeat(sums(n, h), np.diff(np.append(h, len(n)))) for h in (twos, threes))
    at = {w: i for i, w in enumerate(known)}
    hots = [at[a.encode()] << 32 | at[z.encode()] for g, a, z in hot if g == lang and a.encode() in at and z.encode() in at]
    two = ((of_two >= least) | np.isin(pair, hots)) & (pair & HALF != pad)
    three = two & (of_three >= least) & (rest >> 32 != pad)
    four = three & (n >= least) & (rest & HALF != pad)
    # Windows that are equal now, together.
    ended = [np.where(pair >> 32 != pad, pair >> 32, -1), np.where(two, pair & HALF, -1), np.where(three, rest >> 32, -1), np.where(four, rest & HALF, -1)]
    order = np.lexsort(ended[::-1])
    ended, n = [c[order] for c in ended], n[order]
    starts = changes(*ended)
    texts = pa.array(known, pa.binary())
    cols = [texts.take(pa.array(c[starts], mask=c[starts] < 0)).cast(pa.string()) for c in ended]
    return pa.Table.from_arrays([pa.array([lang] * len(starts), pa.string()), *cols, pa.array(sums(n, starts), pa.int64())], names=["lang", *WORDS, "n"])


def shortened(packed: DataFrame, hot: set[tuple[str, str, str]], least: int) -> DataFrame:
    """The windows, ended where a prefix has fewer than ``least`` occurrences.
    A task holds one bucket of one language at a time."""
    schema = "lang string, " + "".join(f"{w} string, " for w in WORDS) + "n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for lang, bucket, fields in zip(*(c.to_pylist() for c in b.columns)):
                if held and key != (lang, bucket):
                    yield from unpacked(key[0], held, hot, least).to_batches()
                    held = []
                key = (lang, bucket)
                held.append(fields)
        if held:
            yield from unpacked(key[0], held, hot, least).to_batches()

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(run, schema)


def phrase_counts(df: DataFrame, least: int, text: str = "text", lang: str = "lang", sizes: Sizes = Sizes()) -> DataFrame:
    """lang, words (an array of 1 to 4) and f for every phrase with ``least``
    occurrences or more, and for each language one row of an empty array with
    the count of all its words."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(quoted(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), quoted(text).alias("text"))
    vocabulary = written(count_words(docs, sizes), "phrase-words")
    is_pair = F.col("word").contains(" ")
    every = vocabulary.where(~is_pair).agg(F.sum("n")).first()[0] or 0
    bits = spark.sparkContext.broadcast(word_filter(vocabulary.where(~is_pair & (F.col("n") >= least)), sizes))
    # at most sizes.hot pairs, as there are no more pairs than words
    hot = {(r["lang"], *r["word"].split(" ")) for r in vocabulary.where(is_pair & (F.col("n") * sizes.hot > every)).collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // sizes.bucket))
    rolled = (
        shortened(windows(docs, bits, hot, buckets, sizes), hot, least)
        .groupBy("lang", *WORDS)
        .agg(F.sum("n").alias("n"))
        .rollup("lang", *WORDS)
        .agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    )
    # gid has a bit for each column that is summed over: none for order 4
    parts = []
    for k in range(ORDER + 1):
        here = F.col("gid") == (1 << (ORDER - k)) - 1
        full = F.col(f"w{k}").isNotNull() & (F.col("f") >= least) if k else F.lit(True)
        parts.append(F.when(here & full, F.array(*WORDS[:k]) if k else F.array().cast("array<string>")))
    found = rolled.select("lang", F.coalesce(*parts).alias("words"), "f").where("words is not null")
    out = written(found, "phrase-counts")
    bits.destroy()
    discard(vocabulary)
    return out


def collocations(
    df: DataFrame, least: int = 30, top: int = 2000, absorb: int = 80, text: str = "text", lang: str = "lang", scale: int = 2_000_000, sizes: Sizes = Sizes()
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``
    phrases of 2 to 4 words with ``least`` or more occurrences.

    Of the cuts of a phrase the lowest score floor(scale * a / (l + r)) counts
    (of equal ones the first cut).  A phrase that lies within a longer
    candidate with ``absorb`` % of its occurrences or more is dropped.  Null
    texts have no words; a null language is 'und'; an empty table, or one
    without such phrases, gives no row; repeated rows count each time.  Other
    columns are not read."""
    counts = phrase_counts(df, least, text, lang, sizes)
    size = F.size("words")
    joined = F.array_join("words", " ").alias("phrase")
    parts = counts.where(size > 0).select(F.col("lang").alias("part_lang"), F.array_join("words", " ").alias("part"), F.col("f"))
    a = counts.where(size > 1).select("lang", joined, "words", F.col("f").alias("a"))
    cuts = a.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )

    def with_count(rows: DataFrame, column: str, name: str) -> DataFrame:
        on = (F.col("lang") == F.col("part_lang")) & (F.col(column) == F.col("part"))
        return rows.join(parts, on).drop("part_lang", "part", column).withColumnRenamed("f", name)

    cuts = with_count(with_count(cuts, "first", "l"), "rest", "r")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    # Each candidate's shorter phrases of two words or more, with the longer one's count.
    spans = [(i, j) for i in range(ORDER) for j in range(i + 2, ORDER + 1)]
    inner = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j - i).alias("m")) for i, j in spans])
    within = counts.where(size > 2).select("lang", "words", F.col("f").alias("longer"), F.explode(inner).alias("at"))
    within = within.where((F.col("at.i") + F.col("at.m") - 1 <= size) & (F.col("at.m") < size))
    within = within.select(F.col("lang").alias("in_lang"), F.array_join(F.slice("words", F.col("at.i"), F.col("at.m")), " ").alias("in_phrase"), "longer")
    within = within.groupBy("in_lang", "in_phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    absorbed = F.col("longer").cast(wide) * 100 >= F.col("a").cast(wide) * absorb
    kept = kept.where(~F.coalesce(absorbed, F.lit(False)))

    order = Window.partitionBy("lang").orderBy(F.col("low.score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = counts.where(size == 0).select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    out = best.join(n, F.col("lang") == F.col("n_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
