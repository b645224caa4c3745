"""Registered queries of the training-data operators: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from disputelens.llm import (bpe, chat_format, langid, license_scan, prefix_trie, quality_qda, quality_rules, sql,
                             suffix_dedup, token_align, toxicity, warc)
from disputelens.llm.common import prepare, read_table
from disputelens.llm.decontam import decontaminate
from disputelens.llm.minhash import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).drop("row")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures_of(read_table(prepare(spark), sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read_table(prepare(spark), sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(prepare(spark), sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return quality_qda.classify(docs, read_table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return quality_rules.judge(docs, read_table(spark, sf_dir, "labels"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(prepare(spark), sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(prepare(spark), sf_dir, "documents"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer file of a contract; only these queries name one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(prepare(spark), sf_dir, "documents"), vocabulary_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return toxicity.classify(docs, read_table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(read_table(prepare(spark), sf_dir, "conversations"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return token_align.digests(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(prepare(spark), sf_dir, "conversations")
    return chat_format.digests(conversations, vocabulary_path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_warc": op2_warc,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language": op4_language,
        "op5_quality": op5_quality,
        "op6_quality_rules": op6_quality_rules,
        "op7_license": op7_license,
        "op8_minhash": op8_minhash,
        "op9_bpe": op9_bpe,
        "op10_toxicity": op10_toxicity,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_align": op12_token_align,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": sql.DECONTAMINATE,
        "op2_warc": sql.CAPTURES,
        "op8_minhash": sql.NEAR_DUPLICATES,
        "op11_prefix_trie": sql.PREFIX_TRIE,
        "op13_chat_format": sql.CHAT_FORMAT,
    }
