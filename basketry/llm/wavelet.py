"""Token ids in wavelet matrices, one file a shard.

A shard holds the ids of consecutive documents.  Its file keeps the ids as
one bit plane per bit, from the highest: plane by plane, the ids are ordered
stably by the bits before, zeros first.  With the number of ones before each
block of ``BLOCK`` bits, which the file holds too, ``rank`` takes one lookup
and one popcount, and ``select`` a binary search.  Opening a file inflates its
planes; from these it answers without unpacking the ids:

* ``access(i)``: the i-th id,
* ``count(id, stop)``: how often an id occurs before a position,
* ``find(id, k)``: where its k-th occurrence is.

File: ``HEADER`` (magic, documents, ids, planes), then parts, each with its
length and zlib-compressed: the doc_ids, their ends, the zeros of each plane,
each plane's bits, and each plane's ones before every block.

Files go through ``pyarrow.fs`` to the folder's own store.  A task writes
under a name of its own and then renames, so a task that is run again, or
twice at once, leaves the same whole file.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.bpe import byte_letters
from basketry.llm.common import Recent, held, quoted, shared_path, written

MAGIC = b"WMTX0002"
HEADER = struct.Struct("<8sQQI")
BLOCK = 512
#: Bits whose places are found together: they stay in a core's own cache.
SPAN = 1 << 16
#: Characters of text that a shard holds, about; bounds a task's memory.
SHARD_CHARS = 16_000_000
#: Files whose ids are summed in one window; another one has a row a run.
RUN_FILES = 4096
#: Pieces of text whose ids a Python worker keeps, and how long they may be.
CACHE_PIECES, SHORT = 1_000_000, 64
PART = "\x01"
#: White space that parts pieces, as one sign.
SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Characters of text that are encoded together.
BLOCK_CHARS = 8 << 20
#: Pieces whose ids are put in order together.
GATHER = 1 << 17
#: Signs of ASCII that end a word of letters (an apostrophe can be part of one),
#: and the words of pieces of ASCII, as the vocabulary splits them.
SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


class WaveletMatrix:
    """Rank and select over bit planes."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.n, self.zeros, self.planes = n, zeros, planes  # planes: packed bits, lowest first
        self.ranks = [self._ones_before(p) for p in planes] if ranks is None else ranks

    @classmethod
    def of(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        kind = np.uint16 if width <= 16 else np.uint32
        now, zeros, planes = np.asarray(ids).astype(kind), [], []
        n, spans = len(now), [slice(a, a + SPAN) for a in range(0, len(now), SPAN)]
        for level in range(width - 1, -1, -1):
            bits = now & kind(1 << level) != 0
            planes.append(np.packbits(bits, bitorder="little"))
            zeros.append(n - int(np.count_nonzero(bits)))
            after, zero, one = np.empty(n, kind), 0, zeros[-1]
            for span in spans:
                part = now[span].compress(~bits[span])
                after[zero : zero + len(part)] = part
                zero += len(part)
                part = now[span].compress(bits[span])
                after[one : one + len(part)] = part
                one += len(part)
            now = after
        return cls(len(now), zeros, planes)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def all(self) -> np.ndarray:
        """All ids: the stable partitions are undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bits, one = self._bits(level), kind(1 << (len(self.planes) - 1 - level))
            before, at, ones = np.empty(self.n, kind), 0, self.zeros[level]
            for a in range(0, self.n, SPAN):
                part, span = before[a : a + SPAN], bits[a : a + SPAN]
                places = np.flatnonzero(~span)
                part[places] = now[at : at + len(places)]
                at += len(places)
                places = np.flatnonzero(span)
                part[places] = now[ones : ones + len(places)] | one
                ones += len(places)
            now = before
        return now.astype(np.uint32)

    @staticmethod
    def _ones_before(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of a plane, and in all."""
        ones = np.bitwise_count(plane).astype(np.int64)
        sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(sums)])

    def rank(self, level: int, bit: int, stop: int) -> int:
        """Bits of this value before ``stop``."""
        block = stop // BLOCK
        plane, at = self.planes[level], block * BLOCK // 8
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[at : stop // 8]).sum())
        if stop % 8:
            ones += (int(plane[stop // 8]) & (1 << stop % 8) - 1).bit_count()
        return ones if bit else stop - ones

    def select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of this value."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.rank(level, bit, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = zeros * bit + self.rank(level, bit, i)
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Where the occurrences before ``stop`` are after the last plane."""
        a, width = 0, len(self.planes)
        if value >> width:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            bit = value >> (width - 1 - level) & 1
            a, stop = zeros * bit + self.rank(level, bit, a), zeros * bit + self.rank(level, bit, stop)
        return a, stop

    def count(self, value: int, stop: int | None = None) -> int:
        a, z = self._range(value, self.n if stop is None else stop)
        return z - a

    def find(self, value: int, k: int = 0) -> int:
        """The position of the k-th occurrence; -1 if there are fewer."""
        a, z = self._range(value, self.n)
        if not 0 <= k < z - a:
            return -1
        i, width = a + k, len(self.planes)
        for level in range(width - 1, -1, -1):
            bit = value >> (width - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] * bit)
        return i


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One shard's file."""
    matrix = WaveletMatrix.of(ids, width)
    parts = [doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), np.array(matrix.zeros, "<u8").tobytes(), *(p.tobytes() for p in matrix.planes)]
    parts += [r.astype("<i8").tobytes() for r in matrix.ranks]
    packed = [zlib.compress(p, 1) for p in parts]
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), width) + b"".join(struct.pack("<Q", len(p)) + p for p in packed)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc_ids, ends, matrix) of a shard's file."""
    magic, _, n, width = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    parts, at = [], HEADER.size
    while at + 8 <= len(raw):
        (size,) = struct.unpack_from("<Q", raw, at)
        parts.append(zlib.decompress(raw[at + 8 : at + 8 + size]))
        at += 8 + size
    if len(parts) != 3 + 2 * width or at != len(raw):
        raise ValueError("a shard of token ids is cut short")
    doc_ids, ends, zeros = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "<u8", "<u8")))
    planes, ranks = ([np.frombuffer(p, t) for p in cut] for cut, t in ((parts[3 : 3 + width], np.uint8), (parts[3 + width :], "<i8")))
    return doc_ids, ends.astype(np.int64), WaveletMatrix(n, zeros.tolist(), planes, ranks)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def save(folder: str, name: str, raw: bytes) -> None:
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(raw)
    fs.move(own, f"{path}/{name}")


def load(folder: str, name: str) -> bytes:
    fs, path = open_folder(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


def plain(text: str) -> bytes:
    """UTF-8 of a text, or of one with the same ids and fewer different
    words, as the vocabulary has lower case only.  Not where lower case could
    make a string of an added token, or compose with a mark."""
    raw = text.encode()
    return raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()


def cut(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls, cut from its one buffer."""
    if not len(values):
        return []
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    first = int(ends[0])
    raw, stops = values.buffers()[2][first : int(ends[-1])].to_pybytes(), (ends - first).tolist()
    return [raw[a:z] for a, z in zip(stops, stops[1:])]


class Encoder:
    """Ids of whole texts by the tokenizers library.  The vocabulary's words
    never span white space, so what stands between that of ASCII (which
    splits bytes) is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = max(1, int(self.lib.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.seen = Recent(CACHE_PIECES)
        # A control sign that is a word of one id by itself parts the pieces
        # that are encoded together.
        mark = self.lib.encode(PART, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("this vocabulary has no sign that parts words")
        self.mark, self.model = mark[0], self.lib.model
        self.runs = Recent(CACHE_PIECES // 4)
        self.byte_letters = {b: c for c, b in byte_letters().items()}

    @staticmethod
    def _word(piece: bytes) -> bool:
        """Whether the piece is one word that the normalizer leaves alone:
        letters, composed, in lower case."""
        word = piece.decode()
        return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)

    def _tokens(self, run: bytes) -> bytes:
        """The ids of one word of the vocabulary's splitting rule, by its model."""
        word = run.decode() if run.isascii() and run.isalpha() else run.decode("latin-1").translate(self.byte_letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _run(self, run: bytes) -> bytes:
        """The same for words that are parts of pieces; they are kept."""
        return self.runs.get(run) or self.runs.old.get(run) or self.runs.keep(run, self._tokens(run))

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Learn the pieces whose words are plain to see: letters, then signs
        or none; or ASCII, where letters, each digit, and what is neither are
        words.  Returns the others."""
        others, run, seen, runs = [], self._run, self.seen, self.runs
        for p in pieces:
            word = p.rstrip(SIGNS)
            if (word.isalpha() and word.islower()) if word.isascii() else self._word(word):
                if len(word) == len(p):
                    seen[p] = runs.get(p) or self._tokens(p)
                else:
                    tail = p[len(word) :]
                    seen[p] = (seen.get(word) or run(word)) + (runs.get(tail) or run(tail))
            elif p.isascii() and b"'" not in p and p == p.lower() and b"<|" not in p:
                self.seen[p] = b"".join(map(run, RUNS.findall(p)))
            else:
                others.append(p)
        return others

    def _together(self, pieces: list[bytes]) -> None:
        """Encode pieces without PART or added tokens by the whole library."""
        whole = self.lib.encode_batch_fast([f" {PART} ".join([p.decode() for p in pieces])], add_special_tokens=False)
        ids = np.array(whole[0].ids, np.uint32)
        stops = np.append(np.flatnonzero(ids == self.mark), len(ids))
        if len(stops) != len(pieces):
            raise ValueError("pieces of text ran together")
        raw, cuts = ids.tobytes(), (4 * stops).tolist()
        self.seen.update(zip(pieces, [raw[x:y] for x, y in zip([0, *(x + 4 for x in cuts[:-1])], cuts)]))

    def _learn(self, pieces: set[bytes]) -> list[bytes]:
        """Ids of new pieces into the table; returns those too long to stay."""
        new = self.seen.lacking(pieces)
        others, odd = [], []
        for p in self._known(list(new)):
            (odd if PART.encode() in p or b"<|" in p else others).append(p)
        others.sort()
        for a in range(0, len(others), 4096):
            self._together(others[a : a + 4096])
        for p in odd:
            self.seen[p] = np.array(self.lib.encode(p.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
        return [p for p in new if len(p) > SHORT]

    def _ids(self, pieces: list[bytes], end: bytes) -> list[bytes]:
        """The ids of different pieces, a line feed's being ``end``.  What the
        table has is taken before it makes room for new pieces."""
        seen = self.seen
        raw = list(map(seen.get, pieces))
        raw[pieces.index(b"")], raw[pieces.index(b"\n")] = b"", end
        lacks = [i for i, ids in enumerate(raw) if ids is None]
        long = self._learn({pieces[i] for i in lacks})
        for i in lacks:
            raw[i] = seen[pieces[i]]
        for p in long:
            del seen[p]
        return raw

    def packed(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, each text's closed by
        ``end_id``, and where each one ends."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # A line feed, which is in no piece, marks the end of a text.
        flat = b"".join([plain(t or "").translate(SPACE) + b" \n " for t in texts])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(flat)])), pa.py_buffer(flat)])
        coded = pc.split_pattern(whole, b" ").flatten().dictionary_encode()
        del flat, whole
        pieces = cut(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ends = at == pieces.index(b"\n")
        raw = self._ids(pieces, np.uint32(end_id).tobytes())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = np.frombuffer(b"".join(raw), np.uint32)
        del coded, pieces, raw
        starts = np.cumsum(sizes) - sizes
        count, out = sizes[at], []
        for a in range(0, len(at), GATHER):
            size = count[a : a + GATHER]
            stop = np.cumsum(size)
            out.append(ids[np.repeat(starts[at[a : a + GATHER]] - stop + size, size) + np.arange(stop[-1])])
        return np.concatenate(out), np.cumsum(count)[ends]


def encoder(path: str) -> Encoder:
    """Loaded once in each Python worker."""
    return held(("wavelet", path), lambda: Encoder(path))


def write_shards(df: DataFrame, vocab: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encode the whole texts and write them in ascending order of doc_id to
    ``folder``.  Returns (shard, name, docs, tokens), one row a file.

    A null text is empty: its document has the end id only.  Rows of one id
    follow each other in the order of a hash of their texts, by which files
    part them too, so one id with many rows is many files; those without an id
    come first under the id -2^63 (an id of that value is not told from it).
    No rows give no files."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(quoted(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), quoted(text).alias("text"))
    chars = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // shard_chars))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(vocab), None
        doc_ids, ends, parts, size = [], [], [], 0
        for b in batches:
            if not len(b):
                continue
            shard = b.column(0)[0].as_py()
            doc_ids.append(b.column(1).to_numpy())
            texts, at = b.column(2), 0
            while at < len(texts):
                block, chars = [], 0
                while at < len(texts) and (not block or chars < BLOCK_CHARS):
                    block.append(texts[at].as_py())
                    chars += len(block[-1] or "")
                    at += 1
                ids, stops = encode.packed(block, end_id)
                parts.append(ids)
                ends.append(stops + size)
                size += len(ids)
        if shard is None:
            return
        ids, stops = np.concatenate(parts), np.concatenate(ends)
        name = f"shard-{shard:06d}.wm"
        save(folder, name, pack(np.concatenate(doc_ids), stops, ids, encode.width))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(stops)], pa.int64()), pa.array([len(ids)], pa.int64())],
            names=["shard", "name", "docs", "tokens"],
        )

    return written(dealt.mapInArrow(run, "shard int, name string, docs long, tokens long"), "wavelet-files")


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of its ids as little-endian
    32-bit integers).  One task reads whole files, one after the other."""
    # What stands before each file: running sums in runs of files, and over the runs.
    of = F.expr(f"shard div {RUN_FILES}")
    runs = files.groupBy(of.alias("run")).agg(F.sum("tokens").alias("all"))
    before = runs.select(F.col("run").alias("of"), (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("before"))
    inner = F.sum("tokens").over(Window.partitionBy("run").orderBy("shard")) - F.col("tokens")
    starts = files.withColumn("run", of).withColumn("inner", inner).join(before, F.col("run") == F.col("of"))
    starts = starts.withColumn("base", F.col("before") + F.col("inner"))
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids, ends, matrix = unpack(load(folder, name))
                ids = memoryview(matrix.all().astype("<u4", copy=False)).cast("B")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == -(1 << 63)), pa.array(begins + base), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return starts.select("name", "base").repartition(width, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(df: DataFrame, vocab: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to a fresh folder of the shared storage and return
    what ``read_shards`` finds in them."""
    folder = shared_path(df.sparkSession, "wavelet")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return read_shards(write_shards(df, vocab, end_id, folder, doc_id, text), folder)
