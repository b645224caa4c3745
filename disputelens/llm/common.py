"""What the training-data operators share.

* ``prepare`` sets the session's Arrow batch size, ``store`` cuts lineage by a
  parquet table in the shared checkpoint folder.
* ``text_chunks`` turns Arrow batches into byte arrays of a bounded size, on
  which words, rolling hashes and shingles are computed with numpy for many
  documents at once. A chunk holds whole documents; one long document is a
  chunk of its own, so memory in a task follows the longest text.

Words are maximal runs of allowed bytes. All separators of the contracts are
ASCII, so runs over UTF-8 bytes are the same as runs over code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputelens.session import delete_path, ensure_checkpoint_dir

#: Bytes of text that one numpy chunk holds (more only for a single long text).
CHUNK_BYTES = 512 << 10
#: Rows and bytes of one Arrow batch between the JVM and Python.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session; make sure the shared folder is known."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ensure_checkpoint_dir(spark)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder (``spark.checkpoint.dir``)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows that one file of a table of known size holds.
FILE_ROWS = 100_000
#: Documents, or rows made of one each, that a task of a step with work to do takes; the same with whole texts.
TASK_ROWS, TEXT_ROWS = 10_000, 2_000


def in_tasks(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with its last step in a task for ``task_rows`` of ``rows``, two for each core at least, if that is fewer.

    Each task takes whole partitions, one after the other, so it needs no more memory;
    but tables of many nearly empty partitions get few files.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, 1 + rows // task_rows))


def store(df: DataFrame, name: str = "t", most_rows: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    A lost executor then costs the running tasks only. The schema is passed on,
    so an empty table reads back too. ``most_rows`` is a bound on the rows, if
    one is known: small tables then get few files. With ``task_rows`` it is the rows
    that the work goes by, see ``in_tasks``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if most_rows is not None:
        df = df.coalesce(1 + most_rows // FILE_ROWS) if task_rows is None else in_tasks(df, most_rows, task_rows)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``store`` that no later step reads."""
    for t in tables:
        delete_path(t.sparkSession, t.stored_at)


def file_bytes(path: str) -> bytes:
    """A file of the driver, to be broadcast: executors needn't have it at that path."""
    with open(path, "rb") as f:
        return f.read()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bitmap_of(df: DataFrame, position: Column, n_bits: int) -> bytes:
    """``n_bits`` bits (a multiple of 32768), set at each row's ``position``.

    Spark builds it in 4 KB pieces, so n_bits / 8 bytes at most reach the
    driver however many rows there are. A set bit may stand for several rows:
    readers use it to skip rows early and join exactly afterwards.
    """
    at = F.col("at") + 1  # Spark numbers bits from 1
    rows = (df.select(position.cast("long").alias("at")).groupBy(F.bitmap_bucket_number(at).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
    out = bytearray(n_bits // 8)
    for r in rows:
        out[(r.bucket - 1) * 4096:r.bucket * 4096] = bytes(r.bits)
    return bytes(out)


class BitFilter:
    """Tests many 64-bit hashes against the bytes of ``bitmap_of``."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.mask = U64(len(bits) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & self.mask
        return (self.bits[(at >> U64(3)).view(np.int64)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) != 0


# --- Arrow batches to byte arrays ------------------------------------------------

def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null gives empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def text_chunks(batches: Iterable[pa.RecordBatch], column: str,
                max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, texts as bytes) of at most ``max_bytes`` of text, or of one row."""
    for batch in batches:
        texts = as_bytes(batch.column(column))
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > max_bytes:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) and c.type == f.type else
         c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)


def lists_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list array from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), type=pa.int32()), pa.array(values))


# --- words -------------------------------------------------------------------------

#: Bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of a word ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240817))
#: Random 64-bit value per byte, the odd base of the rolling hash, and its inverse.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
#: Odd multipliers that mark a word's place in a shingle.
PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Powers of the base and its inverse, grown as longer chunks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """p[i] = sum of value(data[j]) * BASE**j for j < i (modulo 2**64)."""
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(BASE_INV, n)
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * self.up[:n - 1], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span; equal bytes give equal hashes wherever they stand."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def valid_starts(words: "Words", size: int) -> np.ndarray:
    """Indices of words at which ``size`` words of one text start."""
    left = np.repeat(words.range[1:], words.count) - np.arange(len(words.starts))
    return np.flatnonzero(left >= size)


class Words:
    """Words of several texts: bytes, spans, and the word range of each text."""

    def __init__(self, texts: list[bytes], allowed: np.ndarray, lower: bool, rolling: Rolling, hashes: bool = True):
        joined = b" ".join(texts) + b" "
        self.raw = joined.lower() if lower else joined  # bytes.lower() changes A-Z only
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = allowed[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.range = np.searchsorted(self.starts, self.text_start)
        self.count = np.diff(self.range)
        if hashes:
            self.prefix = rolling.prefix(self.data)
            self.hash = rolling.spans(self.prefix, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def shingle_hash(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words for every start (the caller masks text ends)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out += word_hash[i:i + n] * PLACE[i]
    return mix(out + U64(size))
