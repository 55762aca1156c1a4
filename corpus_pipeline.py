"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

language_id      drops text in none of the languages
exact_dedup      of equal texts keeps the row with the largest doc_id
near_dedup       of documents linked by 5-word shingles at a similarity of 0.8 keeps the smallest doc_id
decontamination  drops documents that hold a 10-word window of a benchmark item
byte_bpe         encodes what is left, and decodes it again

A null or empty text has no words and no likelihood: language_id keeps it, exact_dedup takes nulls and
empty texts for equal, the others leave it alone, and it has no tokens.  Of rows that repeat both doc_id
and text exact_dedup leaves one.  A null doc_id is smaller than any other.  Texts are taken whole, however
long.  Other columns are carried, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, exact_dedup, langid, near_dedup
from tessera.llm.common import staged

LANGUAGES = ["de", "en", "es", "fr"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, LANGUAGES)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]
#: Trigram likelihoods, minimum hashes and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
