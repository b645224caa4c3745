"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbouring words, and pairs
with one word between them, hashed into ``BUCKETS``. FTRL-proximal keeps a step
size for each coordinate and an L1 term that leaves most weights at zero.

The training rows are a bounded sample, ``MAX_TRAIN`` labelled documents outside the
held-out fold, by least hash of their id. They are dealt into ``SHARDS``; each
shard is learned by one task in ``EPOCHS`` passes, and the shards' weights are
averaged. The non-zero weights (at most BUCKETS) are broadcast, and every
document is scored in one scan without a shuffle.

Defined cases: a null or empty text has no features and the bias alone as score;
a null id is held out; null labels count nowhere, several labels of one id count
each; without training rows every score is 0.5. Repeated rows are each
returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import ALNUM, PLACE, U64, Rolling, Words, mix, prepare, store, text_chunks
from disputelens.llm.quality_qda import held_out

BITS = 18
BUCKETS = 1 << BITS
MAX_TRAIN = 20_000
SHARDS = 1
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 0.0
#: Weight of a toxic row's gradient (they are the rarer class).
POSITIVE = 5.0


def hashed(texts: list[bytes], rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets of all texts, offsets per text)."""
    words = Words(texts, ALNUM, lower=True, rolling=rolling)
    h, text = words.hash, words.text_of()
    keys, owner = [h], [text]
    for step, salt in ((1, U64(3)), (2, U64(5))):
        same = np.flatnonzero(text[step:] == text[:-step])
        keys.append(mix(h[same] * PLACE[0] + h[same + step] * PLACE[1] + salt))
        owner.append(text[same])
    bucket = (np.concatenate(keys) >> U64(64 - BITS)).astype(np.int64)
    both = np.sort((np.concatenate(owner) << BITS) | bucket)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both & (BUCKETS - 1), np.searchsorted(both >> BITS, np.arange(len(texts) + 1))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for rows, texts in text_chunks(batches, "text"):
        bucket, ends = hashed(texts, rolling)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bucket.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column("h"), rows.column("label"), lists], names=["h", "label", "x"])


def ftrl(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes in the given order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    bias = np.array([BUCKETS])

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == BUCKETS, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for x, y in zip(rows, labels):
            at = np.concatenate([x, bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            g *= POSITIVE if y else 1.0
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], float(w[-1])


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "label"], kind="stable")
    w, b = ftrl([np.asarray(x, dtype=np.int64) for x in pdf.x], pdf.label.tolist())
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": np.append(at, BUCKETS), "w": np.append(w[at], b)})


def fit(docs: DataFrame, labels: DataFrame, id_col: str, folds: int, fold: int) -> tuple[np.ndarray, float]:
    """``docs``: id, text."""
    known = (labels.select(F.col(id_col).alias("id"), F.col("toxic").alias("label"))
             .filter(F.col("label").isin(0, 1) & ~held_out("id", folds, fold))
             .withColumn("h", F.xxhash64("id")).orderBy("h", "id", "label").limit(MAX_TRAIN))
    # the sample has MAX_TRAIN rows of three numbers at most: that bounds the broadcast
    rows = docs.join(F.broadcast(known), "id").select("h", F.col("label").cast("int").alias("label"), "text")
    rows = store(rows.mapInArrow(_train_rows, "h long, label int, x array<int>"), "train")
    found = (rows.withColumn("shard", F.pmod("h", F.lit(SHARDS))).groupBy("shard")
             .applyInPandas(_learn, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas())
    shards = rows.select(F.count_distinct(F.pmod("h", F.lit(SHARDS)))).first()[0]
    weights = np.zeros(BUCKETS + 1)
    weights[found["at"].to_numpy(dtype=np.int64)] = np.round(found["w"].to_numpy(dtype=np.float64) / max(shards, 1), 9)
    return weights[:-1].astype(np.float32), float(weights[-1])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        weights, bias = model.value
        for rows, texts in text_chunks(batches, "text"):
            bucket, ends = hashed(texts, rolling)
            sums = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
            margin = sums[ends[1:]] - sums[ends[:-1]] + bias
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"])
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             folds: int = 5, fold: int = 0) -> DataFrame:
    """id, held_out, score, predicted; one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    model = spark.sparkContext.broadcast(fit(rows, labels, id_col, folds, fold))
    return rows.withColumn("held_out", held_out("id", folds, fold)).mapInArrow(
        _score(model), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
