"""SimHash near-duplicates by segment popcounts.

* ``fingerprints``: one 64-bit SimHash per document, over word shingles.
* ``links``: all pairs of different fingerprints within ``max_bits``, found
  through an embedding.  A fingerprint is cut into 16 segments of 4 bits and
  mapped to their 16 bit counts.  One flipped bit moves one count by one, so
  the Manhattan distance of two count vectors is a lower bound of the Hamming
  distance.  The vectors lie on an integer grid: two of them at distance 2 or
  less have a common grid point within distance 1 of both.  Each fingerprint
  is put into the cells of its own vector and of the neighbours one step
  away (33 at most), cells are joined with themselves, and each candidate is
  verified by the exact Hamming distance.
* ``components``: connected components of the links, by hub contraction.

A cell with over ``CELL`` fingerprints is not joined with itself, as its pairs
would grow with the square.  Its members go by an exact other way: each
fingerprint is put under itself and its 64 one-bit neighbours; those under
one key are within two bits of each other, and get a link to the smallest.

Copies of a text share one fingerprint and count once from there on, so a
group of copies of any size costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.joins import join_back
from basketry.llm.common import dealt, discard, no_tables, quoted, written

SEED = 42
SEGMENTS = 16
#: Largest cell of the grid that is joined with itself.
CELL = 32
#: Shingles hashed before their bits are counted.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text: A-Z in lower case, words between ASCII white
    space, shingles of ``shingle`` words joined by a space (fewer words: the
    whole sequence as one; none, or a null text: 0).  Bit i is 1 if set in
    over half of the shingles' XXH64 values (seed 42)."""
    words = (text or "").encode("utf8", "replace").lower().split()
    if not words:
        return 0
    # Shingle i is a slice of the joined words.
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        cut = slice(at, at + BLOCK)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n][cut], stops[cut])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i, one in enumerate((2 * ones > n).tolist()) if one))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (its 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return df.select(quoted(doc_id).cast("long"), quoted(text)).mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def segment_counts(fp: Column) -> Column:
    """The 16 segment popcounts, packed: nibble i counts the bits of segment i."""
    pairs, fours = F.lit(_signed(0x5555555555555555)), F.lit(_signed(0x3333333333333333))
    # Half adders, as sums in the top bits would overflow a signed long.
    x, y = fp.bitwiseAND(pairs), F.shiftrightunsigned(fp, 1).bitwiseAND(pairs)
    two = x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))
    return two.bitwiseAND(fours) + F.shiftrightunsigned(two, 2).bitwiseAND(fours)


def grid_cells(counts: Column) -> Column:
    """The vector's own cell and those one step away in one segment."""
    cells = [counts]
    for i in range(SEGMENTS):
        step = F.lit(_signed(1 << (4 * i)))
        here = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15))
        cells.append(F.when(here < 4, counts + step))
        cells.append(F.when(here > 0, counts - step))
    return F.array_compact(F.array(*cells))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a < b) between the distinct values of column ``fp``: all pairs
    within ``max_bits`` (at most 2) of normal cells, and from full cells
    links that connect exactly what is connected.  No value is in a link
    with itself; an empty table gives none."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid's cells meet up to a distance of 2")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits
    cells = fps.select("fp", F.explode(grid_cells(segment_counts(F.col("fp")))).alias("cell"))
    sizes = cells.groupBy("cell").count().where("count > 1")
    # Cells of one fingerprint, by far most of them, end here.
    full = written(join_back(dealt(cells), sizes, ["cell"]), "simhash-cells")
    some = full.where(F.col("count") <= CELL)
    a, b = some.select("cell", F.col("fp").alias("a")), some.select("cell", F.col("fp").alias("b"))
    met = dealt(a).join(b, "cell").where((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b"))).select("a", "b")
    return met.unionByName(_hub_links(full.where(F.col("count") > CELL).select("fp").distinct(), max_bits)).distinct()


def _hub_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of the members of full cells, in proportion to their number."""
    x = F.col("fp")
    if max_bits < 2:  # the flipped bits of two members meet at distance 2, so ask for the member itself
        flips = [x.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)] if max_bits else []
        other = fps.select(x.alias("a"), F.explode(F.array(*flips)).alias("b")).where("a < b") if flips else None
        none = fps.select(x.alias("a"), x.alias("b")).where("false")
        return none if other is None else dealt(other).join(fps.select(x.alias("b")), "b", "left_semi").select("a", "b")
    keys = F.array(x, *[x.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    under = fps.select("fp", F.explode(keys).alias("key"))
    hubs = under.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return join_back(dealt(under), hubs, ["key"]).where("a < fp").select("a", F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of
    the edges (a, b).

    Alternates two contractions until nothing changes: each node links its
    larger neighbours to its smallest one (large star), then its smaller
    neighbours and itself to the smallest (small star).  Both keep the
    components; at the end every node points at its root.  Rounds grow with
    the logarithm of the longest path.  Each round is a written table, of
    which the one before is deleted."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "simhash-star")
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_back(dealt(both.where("b > a")), low, ["a"]).select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = join_back(dealt(large), least, ["b"])
        star = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        after = written(star.distinct(), "simhash-star")
        # Both are distinct pairs: equal if as many, and none is new.
        done = now.count() == after.count() and dealt(after).join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = after
        if done:
            break
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _classes(df: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id and fp; and per fingerprint its smallest doc_id and the
    root (the smallest fingerprint) of its component."""
    done = written(fingerprints(df, doc_id, text, shingle), "simhash-fp")
    classes = written(done.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits))
    labelled = dealt(classes).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return done, labelled


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` (long), ``component_id``: the smallest
    doc_id among the documents reachable over links of at most ``max_bits``
    differing bits.  Documents of equal fingerprints, those without words
    among them, are linked.  Repeated rows are kept and share a component;
    rows of a null doc_id stay and never name a component with other rows.
    Other columns are not read."""
    done, labelled = _classes(df, doc_id, text, shingle, max_bits)
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = join_back(dealt(labelled), smallest, ["root"]).select("fp", "component_id")
    return dealt(done).join(of_class, "fp").select("doc_id", "fp", "component_id")


def digest(df: DataFrame, **names) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(df, **names)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``df`` for each group, all columns as they are: that of the
    smallest doc_id, and of rows that share this id the one of the smallest
    fingerprint.  Rows of one id with different texts are different documents;
    of equal ones one stays.  Rows of a null id are kept, as nothing names
    them."""
    done, classes = _classes(df, doc_id, text, shingle, max_bits)
    labelled = written(dealt(done.where("doc_id is not null")).join(classes.select("fp", "root"), "fp"), "simhash-labelled")
    winners = written(labelled.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("w")).select("w.doc_id", "w.fp"), "simhash-winners")
    # An id that has one row is told by the id; the few others by id and fingerprint.
    often = written(labelled.groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-often")
    lost = labelled.select("doc_id").join(winners.select("doc_id"), "doc_id", "left_anti")
    not_plain = lost.unionByName(often).distinct().select(F.col("doc_id").alias("id"))
    key = df["`" + doc_id.replace("`", "``") + "`"]
    plain = df.join(not_plain, key.cast("long") == not_plain["id"], "left_anti")
    again = df.join(often, key.cast("long") == often["doc_id"], "left_semi")
    # The text's fingerprint once more, for these rows alone.
    names = [f"c{i}" for i in range(len(df.columns))]
    at, of = (next(n for n, c in zip(names, df.columns) if c.lower() == x.lower()) for x in (text, doc_id))
    flat = again.toDF(*names)
    kinds = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, df.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(at)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made.view(np.int64))], names=[*b.schema.names, "fp"])

    marked = flat.mapInArrow(run, kinds + "fp long")
    won = winners.select(F.col("doc_id").alias("w_id"), F.col("fp").alias("w_fp"))
    kept = marked.join(won, (F.col(of).cast("long") == F.col("w_id")) & (F.col("fp") == F.col("w_fp")), "left_semi").dropDuplicates([of, "fp"])
    return plain.unionByName(kept.select(*names).toDF(*df.columns))
