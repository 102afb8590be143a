"""Exact duplicates by skew-safe combining.

Texts are equal when they are the same after deleting ASCII white space.  The
digest of a normalised text only says where to look: at every stage texts are
grouped by digest and content together, so a collision never merges two texts.

1. ``local_groups``: each task deduplicates what it reads, in blocks of at
   most ``BLOCK_BYTES`` of different contents.  Every row gets the number of
   its local group; the first row of a group carries the content
   (compressed) and the group's best row and size.
2. Salted merge: local groups are merged under (digest, salt, content).  The
   salt is part of the local group's number, so the local groups of one huge
   group of copies are dealt to ``SALTS`` reducers.
3. Global combine: the salt winners are merged under (digest, content), at
   most ``SALTS`` rows a text.
4. Each local group gets its global winner over the digest, and each row its
   local group's over the group's number.  Only the few digests with more than
   one content (collisions) are resolved by content once more.

Texts cross the network compressed, once per different text of a task's block
and once per salt winner; rows cross it as numbers and digests only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import quoted, written

#: White space of ASCII: space and the controls 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"
#: Reducers that share the local groups of one digest.
SALTS = 16
#: A task's block ends at so many bytes of different contents, or rows.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 200_000

LOCAL = "doc_id long, digest string, grp long, pos long, content binary, best struct<low:long,none:boolean,id:long,grp:long,pos:long>, n long"


def normal(text: str | None) -> bytes:
    """UTF-8 of the text without ASCII white space; null counts as empty."""
    return (text or "").encode("utf8", "replace").translate(None, SPACES)


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


class Block:
    """Local groups of a block of rows."""

    def __init__(self, digest: Callable[[bytes], str], seal: Callable[[bytes], bytes], first: int):
        self.digest, self.seal = digest, seal
        self.next = first
        self.start()

    def start(self) -> None:
        self.rows: list[tuple] = []
        self.groups: list[list] = []
        self.at: dict[str, list[int]] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> bool:
        """Take a row; true when the block is full."""
        content = normal(text)
        key = self.digest(content)
        same = self.at.setdefault(key, [])
        # Whole contents are compared, not digests.
        g = next((i for i in same if self.groups[i][0] == content), None)
        if g is None:
            g = len(self.groups)
            self.groups.append([content, key, None, 0])
            same.append(g)
            self.bytes += len(content)
        group, pos = self.groups[g], len(self.rows)
        # The order in which rows win: most code points, then smallest id.
        rank = (-len(text or ""), doc_id is None, doc_id or 0, self.next + g, pos)
        if group[2] is None or rank < group[2]:
            group[2] = rank
        group[3] += 1
        self.rows.append((doc_id, g))
        return self.bytes >= BLOCK_BYTES or len(self.rows) >= BLOCK_ROWS

    def flush(self) -> pa.RecordBatch:
        seen: set[int] = set()
        out: list[tuple] = []
        for pos, (doc_id, g) in enumerate(self.rows):
            content, key, best, n = self.groups[g]
            if g in seen:
                out.append((doc_id, key, self.next + g, pos, None, None, None))
            else:
                seen.add(g)
                won = dict(zip(("low", "none", "id", "grp", "pos"), best))
                out.append((doc_id, key, self.next + g, pos, self.seal(content), won, n))
        self.next += len(self.groups)
        self.start()
        best_type = pa.struct([("low", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("grp", pa.int64()), ("pos", pa.int64())])
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), best_type, pa.int64()]
        cols = list(zip(*out)) if out else [()] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "digest", "grp", "pos", "content", "best", "n"]
        )


def local_groups(df: DataFrame, doc_id: str, text: str, digest: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of a task start at its own multiple of 2^40.
        block = Block(digest, zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() << 40)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if block.add(i, t.as_py()):
                    yield block.flush()
        yield block.flush()

    return df.select(quoted(doc_id).cast("long"), quoted(text)).mapInArrow(run, LOCAL)


def merged(groups: DataFrame, *keys: Column | str) -> DataFrame:
    return groups.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[bytes], str] = sha256, salts: int = SALTS
) -> DataFrame:
    """Per row of ``df``: doc_id, keep_id (the id of the row that stays),
    group_size, kept, digest.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id; exactly one row of a group is ``kept``,
    also among repeated rows of one id.  A null text counts as empty; a row
    of a null id stays only if no other row of its group has as many code
    points, and names its group by null.  An empty table gives an empty one.
    Other columns are not read.  ``digest`` may collide."""
    local = written(local_groups(df, doc_id, text, digest), "exact-local")
    firsts = local.where(F.col("content").isNotNull())
    salted = merged(firsts, "digest", F.pmod(F.xxhash64("grp"), F.lit(salts)).alias("salt"), "content")
    winners = merged(salted, "digest", "content")
    texts = written(winners.groupBy("digest").agg(F.count("*").alias("texts"), F.min("best").alias("best"), F.min("n").alias("n")), "exact-texts")
    own = firsts.select("digest", "grp")
    single = own.join(texts.where("texts = 1").drop("texts"), "digest").select("grp", "best", "n")
    of_group = single
    many = texts.where("texts > 1").select("digest")
    if not many.isEmpty():  # collisions: the content decides once more, for these digests alone
        again = firsts.join(many, "digest", "left_semi")
        whole = again.select("digest", "content", "grp").join(merged(again, "digest", "content"), ["digest", "content"])
        of_group = single.unionByName(whole.select("grp", "best", "n"))
    of_group = of_group.select(F.col("grp").alias("of"), "best", "n")
    rows = local.select("doc_id", "digest", "grp", "pos").join(of_group, F.col("grp") == F.col("of"))
    keep = F.when(~F.col("best.none"), F.col("best.id"))
    kept = (F.col("grp") == F.col("best.grp")) & (F.col("pos") == F.col("best.pos"))
    return rows.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def hash_table(df: DataFrame, **names) -> DataFrame:
    """The same with the digest as ``text_sha256``."""
    return exact_duplicates(df, **names).withColumnRenamed("digest", "text_sha256")

