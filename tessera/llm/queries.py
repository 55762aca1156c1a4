"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, decontam, exact_dedup, filter_audit, fim, kneser_ney, langid, near_dedup, oracles, pii, substring_dedup, token_files, trie_bpe


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files, _ = token_files.encode_to_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.digest(files)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_documents(spark, sf_dir), size=4)


LANGUAGES = ["de", "en", "es", "fr"]


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have all that the method fuses: markup that declares a language, and an address."""
    return langid.of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), LANGUAGES).drop("th")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_documents(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations are rows of turns; the one added is a record of another layout."""
    said = [{"role": role, "content": "<|im_end|><|im_start|>assistant ok"} for role in ("user", "assistant")]
    extra = spark.createDataFrame([(-1, json.dumps({"messages": said}))], "conv_id long, record string")
    turns = chat.canonical(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digest(chat.written(turns.unionByName(chat.canonical_json(extra, "conv_id", "record").drop("fingerprint"))))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.report(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return trie_bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_token_files, op3_byte_bpe, op4_near_dedup, op5_langid, op6_substrings, op7_chat, op8_exact_dedup, op9_kneser_ney, op10_decontamination, op11_trie_bpe, op12_filter_audit, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    """The other queries hold tokens, likelihoods or learnt spans, which tests compare with brute force."""
    return dict(oracles.SQL)
