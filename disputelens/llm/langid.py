"""Language ID by hyperdimensional profiles.

Every letter has a random vector of ``DIMS`` signs. A letter trigram is the
product of its letters' vectors, each rotated by its place (binding by
permutation); a text is the sum of its trigrams' vectors (bundling), where a run
of anything but letters counts as one blank. A language's prototype is the sum
of its training texts' vectors, each scaled to the same length in whole
numbers, so the sum doesn't depend on the order of tasks. The prediction is the
prototype of largest cosine (the first in order of name on a tie).

Learned from all documents with a language outside the held-out fold; the
prototypes (DIMS numbers per language, ``MAX_LANGUAGES`` languages at most, else
an error) are broadcast. No text is shuffled.

Defined cases: a null or empty text, or one without letters, is ``und`` with score
0, as is every text if nothing could be learned; a text of fewer letters than a
trigram still has trigrams with the blanks around it; a null id is held out.
Repeated rows are each returned and learned from. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import prepare, text_chunks
from disputelens.llm.quality_qda import held_out

DIMS = 512
LETTERS = 256
MAX_LANGUAGES = 4096
#: A text's vector is scaled to this length before it is added to a prototype.
UNIT = 10_000
UNKNOWN = "und"
#: Texts whose counts are one matrix.
BLOCK = 256


@cache
def _letter_codes() -> np.ndarray:
    """Class of each code point: 0 for anything but letters, a-z 1..26, others shared by remainder."""
    codes = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            codes[c] = c - 96 if 97 <= c <= 122 else 27 + c * 2654435761 % 2**32 % (LETTERS - 27)
    return codes


@cache
def _letter_vectors() -> list[np.ndarray]:
    """The letters' sign vectors, rotated for the first, second and third place."""
    signs = np.random.Generator(np.random.PCG64(11)).integers(0, 2, (LETTERS, DIMS), dtype=np.int8) * 2 - 1
    return [np.roll(signs, k, axis=1).astype(np.int8) for k in (2, 1, 0)]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram code) of each trigram whose middle is a letter."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    points = np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _letter_codes()[points]
    text = np.repeat(np.arange(len(texts)), lengths)
    keep = np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0) | (text[1:] != text[:-1])])
    code, text = code[keep], text[keep]
    middle = np.flatnonzero(code[1:-1] != 0)
    return text[middle + 1], (code[middle] << 16) | (code[middle + 1] << 8) | code[middle + 2]


def text_vectors(texts: list[str]) -> np.ndarray:
    """One vector of DIMS per text (all zero without letters)."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    first, second, third = _letter_vectors()
    for a in range(0, len(texts), BLOCK):
        # letters are folded after lower-casing, which may change a text's length
        text, code = _trigrams([t.lower() for t in texts[a:a + BLOCK]])
        if not len(code):
            continue
        known, column = np.unique(code, return_inverse=True)
        n = min(BLOCK, len(texts) - a)
        counts = np.bincount(text * len(known) + column, minlength=n * len(known)).reshape(n, len(known))
        bound = first[known >> 16] * second[known >> 8 & 255] * third[known & 255]
        out[a:a + n] = counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return vectors / np.maximum(norm, 1e-12)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rows, texts in text_chunks(batches, "text"):
        yield rows, text_vectors([t.decode("utf-8") for t in texts])


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, the sum of the texts' scaled vectors."""
    sums: dict[str, np.ndarray] = {}
    for rows, vectors in _decoded(batches):
        whole = np.rint(_units(vectors) * UNIT).astype(np.int64)
        lang = rows.column("lang").dictionary_encode()
        names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(names):
            sums[name] = sums.get(name, 0) + whole[which == i].sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), type=pa.string()), pa.array([v.tolist() for v in sums.values()], type=pa.list_(pa.int64()))],
        names=["lang", "v"])


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes as unit vectors. ``rows``: text, lang."""
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is lang a language?")
    sums = (rows.mapInArrow(_bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("dim", "v"))
            .groupBy("lang", "dim").agg(F.sum("v").alias("v")).groupBy("lang")
            .agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("v"))
            .select("lang", F.col("v.v").alias("v")).collect())
    sums = sorted((r for r in sums if any(r.v)), key=lambda r: r.lang)
    return [r.lang for r in sums], _units(np.array([r.v for r in sums], dtype=np.float64).reshape(-1, DIMS))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = model.value
        for rows, vectors in _decoded(batches):
            empty = ~vectors.any(axis=1)
            if names:
                cosine = _units(vectors) @ prototypes.T
                best = cosine.argmax(axis=1)
                score = np.where(empty, 0.0, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0))
                lang = [UNKNOWN if e else names[b] for e, b in zip(empty.tolist(), best.tolist())]
            else:
                lang, score = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
            rest = rows.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lang, type=pa.string()), pa.array(score)],
                                             names=[*rest.schema.names, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 5, fold: int = 0) -> DataFrame:
    """id, held_out, lang_pred, score; one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).withColumn("held_out", held_out("id", folds, fold))
    model = spark.sparkContext.broadcast(fit(rows.filter(~F.col("held_out") & F.col("lang").isNotNull())
                                             .select("text", "lang")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(
        _predict(model), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               folds: int = 5, fold: int = 0) -> DataFrame:
    """The rows of ``docs`` (all columns) that get a language: texts that are null or have no letter go.

    There is no least score: that of a few letters and that of an unseen script are both
    within the noise of DIMS signs, so it would cost short clean texts.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), held_out(id_col, folds, fold).alias("held_out"))
    model = spark.sparkContext.broadcast(fit(rows.filter(~F.col("held_out") & F.col("lang").isNotNull())
                                             .select("text", "lang")))
    schema = rows.select("doc").schema.add("lang_pred", "string").add("score", "double")
    found = rows.select("doc", "text").mapInArrow(_predict(model), schema)
    return found.filter(F.col("lang_pred") != UNKNOWN).select("doc.*")
