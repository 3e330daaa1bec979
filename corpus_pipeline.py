"""From raw documents to token ids, in stages: each takes (spark, docs, sf_dir), is written as Parquet and read by the next.

language_id      rows without a letter, or whose language is less likely than ``MIN_SCORE``, go; a null lang is filled in
simhash          one document of each group of near copies stays, that with the least id
substring_dedup  passages of 20 words and more that an earlier document has are cut out; documents that were nothing else go
source_mixing    documents are repeated or left out to meet the sources' target weights, and shuffled
byte_bpe         token ids of every whole text, decoded again to see that nothing is lost
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import byte_bpe, language_id, simhash, source_mixing, substring_dedup
from depweave.llm.common import materialise, text_bytes

#: With four languages a clean text scores about 1; a third is what no language stands out at.
MIN_SCORE = 1 / 3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language_id.predict(docs, language_id.train(docs))
    kept = judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.replicate(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), exact (the ids decode to the text's bytes)."""
    # A digest stands for the text from here on, so that workers don't hold it twice.
    own = docs.select("doc_id", "lang", "source", "text", F.sha2(text_bytes(), 256).alias("__sha"))
    decoded = byte_bpe.decode(byte_bpe.encode(own, keep_text=False))
    return decoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("__sha")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("simhash", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("source_mixing", mix),
    ("byte_bpe", tokenize),
]
#: XXH64 with a seed, merges by rank and fitting by expectation-maximisation have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
