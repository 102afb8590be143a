"""The corpus pipeline: documents to token ids in five stages.

Each stage takes all rows that the one before kept, and is written as Parquet
and read again before the next one starts.  All stages but the last return
the columns of ``documents``.

1. ``language``: rows whose language the identifier predicts with a score of
   at least 0.5 stay; 'und' (no letter, null) goes.
2. ``near_dedup``: of each SimHash component the document with the smallest
   id stays.
3. ``pii``: personal data and secrets get surrogates.
4. ``mixing``: domains, languages and sources are taken to target weights,
   each document once at most.
5. ``bpe``: doc_id, lang, source, n_tokens and ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, langid, mixing, simhash, surrogates
from basketry.llm.common import discard, table, written
from basketry.llm.queries import BYTE_BPE, MIX_SHARE, MIX_WEIGHTS, PIECES, SURROGATE_KEY, mix_levels

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, PIECES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text, as replaced addresses can be longer."""
    done = surrogates.replace(docs, SURROGATE_KEY)
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, max_epochs=1).drop("epoch")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs.select("doc_id", "text", "lang", "source"), BYTE_BPE)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [("language", language), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


#: Fingerprints, learned models and BPE merges have no SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None
