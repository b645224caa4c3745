"""The corpus pipeline: documents in, clean distinct documents with token ids out.

``STAGES`` are applied in order; each takes all that the stage before it kept,
written as parquet and read again, and its decisions take effect:

1. language ID: texts that get no language (null or without letters) go;
2. near-dedup: one document of each group of near copies stays;
3. suffix-array dedup: bytes that a repeated 200-byte string covers are cut out
   (``n_chars`` follows the text);
4. decontamination: documents with a benchmark window go;
5. BPE: token ids of each document, and digests of ids and decoded text.

All stages but the last return the columns of ``documents``: doc_id, text and lang
are needed, n_chars follows the text if it is there. Null texts leave at
stage 1; texts that stage 3 empties stay as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputelens.llm import bpe, decontam, langid, minhash, suffix_dedup
from disputelens.llm.common import prepare, read_table, scratch_path
from disputelens.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.kept_texts(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    done = bpe.encode(docs, vocabulary_path())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: No SQL: the language profiles and the tokenizer's merges are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
