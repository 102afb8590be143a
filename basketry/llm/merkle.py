"""A Merkle manifest of a table by time-forward processing.

Every document is a leaf.  The leaves of a language, in ascending doc_id, form
a tree in which runs of (two) consecutive nodes are hashed into their parent
until one node, the subroot, remains; the subroots in order of language form
the top tree with the root.

Time-forward processing evaluates a tree in the order of its node labels (all
children before their parents): a node's digest is a message to its parent,
and an external priority queue ordered by label hands it over when the parent's
turn comes (``forward``).  The reversed sweep goes from the top label down:
each node hands its proof suffix, with the siblings of the child in front, to
each of its children (``backward``).

Spark deals a tree of any size as blocks of ``run ** levels`` consecutive nodes
of one level.  Each block is swept by one task; its top node is a node of the
next round, so there are log(n) / log(run ** levels) rounds, and one huge
language is many blocks.  The backward rounds take the suffixes of the tops,
read from the shared folder, back into the blocks.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.numbering import dense_numbers
from basketry.llm.common import discard, quoted, written

#: Messages that the queue holds in memory; more go to sorted runs on disk.
QUEUE = 1 << 15
#: Leaves to be tampered: this divides the crc32 of the decimal doc_id.
TAMPER = 7
NODES = "tree string, idx long, n long, digest string"
PATHS = "tree string, idx long, path string, subroot string, root string"
LEAVES = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class LabelQueue:
    """Priority queue of (label, message) with bounded memory: what exceeds
    ``limit`` is written as a sorted run into a temporary file of the task
    and merged when popped.  Messages of one label come in the order of
    their arrival."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.seq = limit, [], [], 0

    def push(self, label: int, message) -> None:
        if len(self.heap) >= self.limit:
            self.spill()
        heapq.heappush(self.heap, (label, self.seq, message))
        self.seq += 1

    def spill(self) -> None:
        run = tempfile.TemporaryFile()
        for item in sorted(self.heap):
            pickle.dump(item, run)
        run.seek(0)
        self.heap = []
        self._next(run)

    def _next(self, run) -> None:
        """Put the run's first item at its place among the runs."""
        try:
            label, seq, message = pickle.load(run)
            heapq.heappush(self.runs, (label, seq, message, run))
        except EOFError:
            run.close()

    def label(self) -> int | None:
        heads = [q[0][0] for q in (self.heap, self.runs) if q]
        return min(heads) if heads else None

    def pop(self):
        """The message of the smallest label."""
        if self.runs and (not self.heap or self.runs[0][:2] < self.heap[0][:2]):
            _, _, message, run = heapq.heappop(self.runs)
            self._next(run)
            return message
        return heapq.heappop(self.heap)[2]


@dataclass(frozen=True)
class Shape:
    """``run`` nodes are hashed into one parent; a block spans ``levels`` levels;
    its queues hold ``limit`` messages in memory."""

    run: int = 2
    levels: int = 12
    limit: int = QUEUE

    @property
    def block(self) -> int:
        return self.run**self.levels

    def sizes(self, m: int, n: int) -> list[int]:
        """Nodes of a block by level: ``m`` at its lowest level, where the tree
        has ``n``; the levels end at the block's top."""
        out = [m]
        while n > 1 and len(out) <= self.levels:
            m, n = -(-m // self.run), -(-n // self.run)
            out.append(m)
        return out

    def forward(self, digests: list[str], n: int) -> list[str]:
        """The digests of all nodes of a block by label: level by level from
        the given ones to the block's top."""
        queue, log = LabelQueue(self.limit), []
        sizes = self.sizes(len(digests), n)
        for level, size in enumerate(sizes):
            parents = len(log) + size
            for i in range(size):
                if level:
                    children, label = [], len(log)
                    while queue.label() == label:
                        children.append(queue.pop())
                    log.append(sha("".join(children)))
                else:
                    log.append(digests[i])
                if level + 1 < len(sizes):
                    queue.push(parents + i // self.run, log[-1])
        return log

    def backward(self, log: list[str], m: int, n: int, path: str) -> list[str]:
        """The proof paths of a block's lowest nodes, given its top's path.  A
        path has one step a level, joined by "/": the digests left of the
        node, "^", and those right of it."""
        queue, out = LabelQueue(self.limit), [""] * m
        sizes = self.sizes(m, n)
        starts = [sum(sizes[:level]) for level in range(len(sizes))]
        queue.push(-(len(log) - 1), path)
        for level in range(len(sizes) - 1, -1, -1):
            for i in range(sizes[level] - 1, -1, -1):
                suffix = queue.pop()
                if not level:
                    out[i] = suffix
                    continue
                first = starts[level - 1] + i * self.run
                last = min(first + self.run, starts[level])
                for child in range(first, last):
                    step = "".join(log[first:child]) + "^" + "".join(log[child + 1 : last])
                    queue.push(-child, f"{step}/{suffix}" if suffix else step)
        return out


def proof_of(path: str) -> str:
    """H of all siblings on the path, left to right and leaf to root."""
    return sha(path.replace("^", "").replace("/", ""))


def fold(leaf: str, path: str) -> str:
    """The root that follows from a leaf and its path."""
    for step in path.split("/") if path else []:
        left, right = step.split("^")
        leaf = sha(left + leaf + right)
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[tuple]]]:
    """Consecutive rows of one tree and block."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and row[:2] != key:
                yield *key, rows
                rows = []
            key = row[:2]
            rows.append(row[2:])
    if rows:
        yield *key, rows


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a tree's block in one task, in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _block_of(shape: Shape) -> Column:
    return F.expr(f"idx div {shape.block}").alias("block")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.rsplit(" ", 1) for f in schema.split(", ")))
    types = [{"string": pa.string(), "long": pa.int64()}[k] for k in kinds]
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))


def tops(nodes: DataFrame, shape: Shape) -> DataFrame:
    """One round up: the top node of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in _blocks(batches):
            n = rows[0][1]
            top = shape.forward([d for _, _, d in rows], n)[-1]
            yield _table([(tree, block, -(-n // shape.block), top)], NODES)

    return _dealt(nodes.select("tree", _block_of(shape), "idx", "n", "digest"), "idx").mapInArrow(run, NODES)


def climb(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The nodes of every round, from the given ones to one node a tree."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(written(tops(rounds[-1], shape), "merkle-tops"))
        most = -(-most // shape.block)
    return rounds


def descend(nodes: DataFrame, above: DataFrame, shape: Shape, leaves: bool = False) -> DataFrame:
    """One round down: ``above`` has the path, subroot and root of every block's
    top; the block's nodes get theirs.  ``leaves``: the nodes carry doc_id and
    ``bad`` (the tampered leaf or null), and the documents' rows come out."""
    extra = ["doc_id", "bad"] if leaves else []
    none = {"idx": "long", "n": "long", "digest": "string", "doc_id": "long", "bad": "string"}
    given = ["path", "subroot", "root"]
    heads = above.select("tree", F.col("idx").alias("block"), F.lit(0).alias("kind"), *[F.lit(None).cast(none[c]).alias(c) for c in ("idx", "n", "digest", *extra)], *given)
    rest = nodes.select("tree", _block_of(shape), F.lit(1).alias("kind"), "idx", "n", "digest", *extra, *[F.lit(None).cast("string").alias(c) for c in given])
    schema = LEAVES if leaves else PATHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _, rows in _blocks(batches):
            path, subroot, root = rows[0][-3:]
            own = rows[1:]
            n = own[0][2]
            paths = shape.backward(shape.forward([r[3] for r in own], n), len(own), n, path)
            if leaves:
                made = [(r[4], r[3], subroot, root, proof_of(p), fold(r[5] or r[3], p)) for r, p in zip(own, paths)]
            else:
                made = [(tree, r[1], p, subroot, root) for r, p in zip(own, paths)]
            yield _table(made, schema)

    return _dealt(heads.unionByName(rest), "kind", "idx").mapInArrow(run, schema)


def leaf_digests(df: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """doc_id, tree (the language), digest, and bad: the leaf's digest with
    n_chars + 1 where the document is to be tampered, else null."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    id_, chars = quoted(doc_id).cast("long"), quoted(n_chars).cast("decimal(20,0)")

    def leaf(chars: Column) -> Column:
        return F.sha2(F.concat(*[part(c) for c in (id_, quoted(source), quoted(lang), chars, quoted(text))]), 256)

    chosen = F.crc32(id_.cast("string").cast("binary")) % TAMPER == 0
    return df.select(
        id_.alias("doc_id"), quoted(lang).cast("string").alias("tree"), leaf(chars).alias("digest"), F.when(chosen, leaf(chars + 1)).alias("bad")
    )


def manifest(df: DataFrame, shape: Shape = Shape(), **names) -> DataFrame:
    """Per row of ``df``: doc_id, leaf, subroot, root, proof_sha256 (of the
    untampered table), folded_root (from the leaf, tampered where its id says
    so, and the untampered siblings) and verified.

    Rows of a null language form a tree of their own, first in the top tree;
    an empty text is a value, a null one "-".  Rows of one id, repeated rows
    among them, are leaves of their own, in the order of their digests; null
    ids come first.  A lone leaf is its language's subroot and a lone subroot
    the root; without siblings the proof is the digest of nothing.  An empty
    table gives an empty one.  Other columns are not read."""
    placed = dense_numbers(
        leaf_digests(df, **names), ["doc_id", "digest"], ["tree"], "idx", "n", save=lambda t: written(t, "merkle-leaves")
    )
    leaves = written(placed, "merkle-placed")
    rounds = climb(leaves, shape)
    subroots = dense_numbers(rounds[-1].select(F.col("tree").alias("lang"), "digest"), ["lang"], [], "idx", "n", save=lambda t: written(t, "merkle-subroots"))
    top = climb(subroots.withColumn("tree", F.lit(None).cast("string")), shape)
    above = top[-1].select("tree", "idx", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(top[:-1]):
        above = written(descend(nodes, above, shape), "merkle-paths")
    of = subroots.select("lang", F.col("idx").alias("at"), F.col("digest").alias("subroot"))
    above = above.drop("subroot").join(of, F.col("idx") == F.col("at"))
    above = above.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
    above = written(above, "merkle-paths")
    for nodes in reversed(rounds[1:-1]):
        above = written(descend(nodes, above, shape), "merkle-paths")
    found = written(descend(leaves, above, shape, leaves=True), "merkle-proofs")
    for used in rounds + top[1:]:
        discard(used)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
