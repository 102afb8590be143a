"""The registered queries: one thin query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, chat, exact, html, langid, merkle, mixing, phrases, quality, search, simhash, surrogates, wavelet
from basketry.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "documents"

#: The mix: domain, language, source.  Sources 0 to 9 count as web, all others
#: and documents without a source as reference.
MIX_WEIGHTS: dict[mixing.Path, float] = {
    ("web",): 0.6,
    ("reference",): 0.4,
    ("web", "en"): 0.5,
    ("web", "de"): 0.2,
    ("web", "fr"): 0.2,
    ("reference", "en"): 0.4,
    ("web", "en", "src0"): 0.3,
}
MIX_SHARE, MIX_EPOCHS = 0.75, 2


def mix_levels() -> dict[str, Column]:
    source = F.col("source")
    domain = F.when(source.rlike("^src[0-9]$"), "web").otherwise("reference")
    return {"domain": domain, "lang": F.col("lang"), "source": source}


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of ids divisible by 20 against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where(F.col("doc_id") % 20 == 0), k=10)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY, counts="n_replaced")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    return mixed.select("doc_id", "lang", "source", mixing.n_words(F.col("text")).alias("n_tokens"), "epoch")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.store_and_read(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(turns.unionByName(chat.control_strings(spark)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), PIECES)


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.hash_table(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_search": op2_search,
        "op3_surrogates": op3_surrogates,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_html": op6_html,
        "op7_wavelet": op7_wavelet,
        "op8_chat": op8_chat,
        "op9_quality": op9_quality,
        "op10_langid": op10_langid,
        "op11_exact": op11_exact,
        "op12_merkle": op12_merkle,
        "op13_phrases": op13_phrases,
    }
