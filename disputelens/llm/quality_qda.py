"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text gives ``FEATURES`` statistics, transformed by log or square root so
that they are roughly normal. Each class has a mean and a covariance shrunk
towards its own diagonal and a floor; the score is the logistic of the
difference of the classes' log densities, each from a Mahalanobis distance by
the cached inverse Cholesky factor. The moments are sums of fixed-point numbers,
so the fit doesn't depend on the order of tasks.

Learned from all labelled rows outside the held-out fold; only the sums (two
classes, 15 x 15) reach the driver.

Defined cases: a null or empty text has all statistics 0 and is scored like any
other; a null id is held out and joins no label; labels that are null count
nowhere, several labels of one id count each; if a class has fewer than two
rows, every score is the share of label 1 (0.5 without labels). Repeated rows are
each returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import Rolling, prepare, store, text_chunks
from disputelens.llm.textstats import TextStats

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks",
            "line_length", "spaces", "other_bytes", "longest")
#: Share of the diagonal in a class covariance, and the variance added to it.
SHRINKAGE, FLOOR = 0.1, 1e-3
#: Statistics are rounded to multiples of 1/SCALE for exact sums.
SCALE = 1024

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([b in b".,;:!?'\"()-" for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_OTHER = np.array([b >= 128 for b in range(256)])


def features(texts: list[bytes], rolling: Rolling) -> np.ndarray:
    """One row of FEATURES per text, rounded to 1/SCALE."""
    s = TextStats(texts, rolling)
    words, size = np.maximum(s.n_words, 1), np.maximum(s.n_bytes, 1)
    spans = s.words.ends - s.words.starts
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, s.word_text, spans)
    ratio = lambda a, b: np.sqrt(a / b)
    columns = [
        np.log1p(s.n_words), np.log1p(s.word_chars / words), ratio(s.n_symbols, words),
        ratio(s.n_dup_lines, np.maximum(s.n_lines, 1)), ratio(s.n_repeat_words, words),
        s.distinct_words() / words, ratio(s.count_bytes(_UPPER), size), ratio(s.count_bytes(_DIGIT), size),
        ratio(s.count_bytes(_MARK), size), np.log1p(s.n_words / np.maximum(s.n_lines, 1)),
        ratio(s.count_bytes(_SPACE), size), ratio(s.count_bytes(_OTHER), size), np.log1p(longest),
    ]
    return np.round(np.stack(columns, axis=1) * SCALE) / SCALE


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for rows, texts in text_chunks(batches, "text"):
        x = features(texts, rolling)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=["id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (1, x) (1, x)^T per class, in fixed point."""
    k = len(FEATURES) + 1
    sums = np.zeros((2, k, k), dtype=np.int64)
    for b in batches:
        x = np.rint(np.hstack([np.ones((b.num_rows, 1)), _matrix(b)]) * SCALE).astype(np.int64)
        y = b.column("label").to_numpy()
        for c in (0, 1):
            sums[c] += x[y == c].T @ x[y == c]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k * k)), pa.array(sums.reshape(-1))], names=["at", "v"])


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    def __init__(self, sums: np.ndarray):
        moments = sums / SCALE**2
        self.n = moments[:, 0, 0]
        self.prior = 0.5 if self.n.sum() == 0 else self.n[1] / self.n.sum()
        self.fitted = bool((self.n >= 2).all())
        if not self.fitted:
            return
        self.parts = []
        for m, n in zip(moments, self.n):
            mean = m[0, 1:] / n
            cov = m[1:, 1:] / n - np.outer(mean, mean)
            cov = (1 - SHRINKAGE) * cov + np.diag(SHRINKAGE * np.diag(cov) + FLOOR)
            chol = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(chol).T, 2 * np.log(np.diag(chol)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), float(self.prior))
        density = [-0.5 * (((x - mean) @ half) ** 2).sum(axis=1) - 0.5 * log_det for mean, half, log_det in self.parts]
        margin = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls in ``fold``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Discriminant:
    """``table``: id, x, held_out."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    rows = table.filter(~F.col("held_out")).join(known, "id").select("x", "label")
    k = len(FEATURES) + 1
    sums = rows.mapInArrow(_moments, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 * k * k)
    flat[sums["at"].to_numpy(dtype=np.int64)] = sums["v"].to_numpy(dtype=np.float64)
    return Discriminant(flat.reshape(2, k, k))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.score(_matrix(b))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"])
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             folds: int = 3, fold: int = 1) -> DataFrame:
    """id, held_out, score, predicted; one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    table = store(rows.mapInArrow(_features, f"id {kind}, x array<double>")
                  .withColumn("held_out", held_out("id", folds, fold)), "features")
    model = spark.sparkContext.broadcast(fit(table, labels, id_col))
    return table.mapInArrow(_score(model), f"id {kind}, held_out boolean, score double, predicted int"
                            ).withColumnRenamed("id", id_col)
