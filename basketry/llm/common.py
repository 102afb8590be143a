"""Helpers shared by the operators: table access, written tables, sizes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources import files

#: White space of the word rules: space and the ASCII controls 9 to 13.
WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str | None:
    """A fresh folder under ``spark.checkpoint.dir`` (the storage that the
    driver and all executors share), or None where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back:
    the lineage is cut, a lost executor rereads files, and what follows does
    not compute ``df`` again.  The files go when the application ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    files.delete_at_end(spark, path)
    df.write.parquet(path)  # executors that are lost are made up for by the write's commit
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals out both sides by the key and broadcasts
    neither.  Spark sizes a table by its files and its columns, not by rows:
    after an explode a row counts once, and columns of repeated values are many
    times larger in memory than in their files.  Tables that grow with the
    documents would be gathered in the driver as long as these look small."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing reads
    it any more."""
    files.delete(df.sparkSession, df._written_to)


_held: dict = {}


def held(key: Hashable, make: Callable):
    """What a Python worker has loaded for its operator, made once.  Workers
    serve later stages too, so what another operator left in one goes first:
    a worker holds the tables of one operator at a time."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()  # tables and their owners refer to each other
        _held[key] = make()
    return _held[key]


def no_tables() -> None:
    """For operators without tables: those of others go from the worker."""
    held("none", bool)


class Recent(dict):
    """A table of at most ``size`` entries in two generations: when the young
    one is full it becomes the old one, and what is asked for again moves
    back.  So common keys stay while rare ones pass."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size // 2, {}

    def keep(self, key, value):
        if len(self) >= self.size:
            self.rotate()
        self[key] = value
        return value

    def rotate(self) -> None:
        self.old = dict(self)
        self.clear()

    def lacking(self, keys: set) -> set:
        """Make room for all ``keys`` together, move back what the old
        generation has, and return what neither has."""
        new = keys.difference(self)
        if len(self) and len(self) + len(new) > self.size:
            self.rotate()
            new = keys
        if self.old:
            back = new.intersection(self.old)
            self.update(zip(back, map(self.old.__getitem__, back)))
            new = new - back
        return new


def replace_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with ``cols`` set; names that differ only in case from a new
    name (Spark would call them ambiguous) give way to it."""
    low = {c.lower() for c in cols}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in low], *[v.alias(k) for k, v in cols.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
