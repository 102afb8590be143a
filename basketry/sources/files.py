"""Questions to the file system of a path, through Hadoop's API, so that
cluster storage is seen as well as local folders."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def content_key(spark: SparkSession, folder: str) -> str:
    """Changes when a file under ``folder`` is added, removed or rewritten:
    a digest of all paths, sizes and modification times."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return ""
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete when the application ends."""
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)
