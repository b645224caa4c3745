"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials are
counted over all documents: one over the trusted target (documents that
``labels.quality`` marks 1) and one over the raw corpus. A document's score is
the sum of log(target / raw) over its n-grams divided by their number; it is
kept if the base rules pass and the score reaches ``THRESHOLD``. Every document
is scored and judged by the same fixed threshold.

The raw corpus is counted in a scan. Trusted texts meet their labels in a shuffled join
by id (labels grow with the corpus), after a bitmap of the trusted ids. Counts are added up in the task, then by bucket; the weights (BUCKETS doubles)
are all that is broadcast.

Defined cases: a null or empty text has no words and fails the base rules; its
score is 0. A null id or null label is never trusted; several labels of one id
trust it if any is 1. Without any trusted document all weights are 0, so the
base rules decide alone. Repeated rows are each returned and counted. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import U64, BitFilter, Rolling, bitmap_of, prepare, shingle_hash, text_chunks
from disputelens.llm.textstats import TextStats

BUCKETS = 1 << 17
#: Bits of the bitmap of trusted ids (1 MB); beyond some millions of them it saves less, the result is the same.
ID_BITS = 1 << 23
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Least mean log ratio of a kept document.
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def ngram_buckets(stats: TextStats) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word and each pair of neighbouring words."""
    text = stats.word_text
    pairs = np.flatnonzero(text[1:] == text[:-1])
    two = shingle_hash(stats.words.hash, 2)[pairs] if len(pairs) else np.zeros(0, dtype=np.uint64)
    bucket = (np.concatenate([stats.words.hash, two]) >> U64(64 - 17)).astype(np.int64)
    return bucket, np.concatenate([text, text[pairs]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for _, texts in text_chunks(batches, "text"):
        counts += np.bincount(ngram_buckets(TextStats(texts, rolling))[0], minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])


def count_ngrams(texts: DataFrame) -> np.ndarray:
    """N-grams per bucket in the column ``text``, added up in the tasks and then by bucket."""
    found = (texts.select("text").mapInArrow(_count, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found.bucket] = found.n
    return out


def _passing(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = BitFilter(bits.value)
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column("at").to_numpy())))
    return run


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` of each document that a label trusts. A bitmap of the trusted ids drops most of the
    others in the scan; what passes is joined by id, so little more than the trusted texts is shuffled."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    trusted = (labels.filter("quality = 1").select(F.col(id_col).try_cast(kind).alias("id"))
               .where(F.col("id").isNotNull()).distinct())
    bits = spark.sparkContext.broadcast(bitmap_of(
        trusted.select(F.xxhash64("id").alias("at")), F.pmod("at", F.lit(ID_BITS)), ID_BITS))
    rows = docs.select(F.xxhash64(id_col).alias("at"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    passed = rows.mapInArrow(_passing(bits), f"at long, id {kind}, text string")
    return passed.join(trusted.hint("merge"), "id", "left_semi").select("text")  # dealt by id, at every size


def fit_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) for each bucket, from all documents."""
    target = count_ngrams(trusted_texts(docs, labels, id_col, text_col))
    if not target.any():
        return np.zeros(BUCKETS)
    raw = count_ngrams(docs.select(F.col(text_col).cast("string").alias("text")))
    return np.log((target + SMOOTHING) / (target + SMOOTHING).sum()) - np.log((raw + SMOOTHING) / (raw + SMOOTHING).sum())


def _judge(weights, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, w = Rolling(), weights.value
        for rows, texts in text_chunks(batches, "text"):
            s = TextStats(texts, rolling)
            bucket, text = ngram_buckets(s)
            n = len(texts)
            total = np.bincount(text, weights=w[bucket], minlength=n)
            score = total / np.maximum(np.bincount(text, minlength=n), 1)
            failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), *map(pa.array, (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines,
                                                    s.n_repeat_words, failed, ~failed & (score >= threshold), score))],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "score"])
    return run


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """id, the base counts, base_failed, kept, score; one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    weights = spark.sparkContext.broadcast(fit_weights(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        _judge(weights, threshold),
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, score double").withColumnRenamed("id", id_col)
