"""Groups of any size in order: ranges instead of one task per group, digests by streaming.

``in_ranges`` sorts rows over the cluster, so a group that holds a third of all
rows takes several ranges. ``digest_in_order`` hashes the pieces of each group in
order; SHA-256 is sequential by definition, so a group's bytes pass through one
hash object, but as a stream: a task holds one Arrow batch of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``part``, sorted by ``order`` (nulls first) from part to part and within.

    Equal rows are told apart by their place in the input, so many of them don't
    share a range either.
    """
    tied = df.withColumn("__place", F.monotonically_increasing_id())
    return (tied.repartitionByRange(*order, "__place").sortWithinPartitions(*order, "__place")
            .withColumn("part", F.spark_partition_id()).drop("__place"))


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, end) of each run of rows with equal keys."""
    columns = [batch.column(k).to_pylist() for k in keys]
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or any(c[i] != c[start] for c in columns):
            yield tuple(c[start] for c in columns), start, i
            start = i


def _digests(keys: list[str], data: list[str], sums: list[str], between: bytes) -> Callable:
    def flush(done: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * (len(keys) + len(data) + len(sums))
        types = [batch.schema.field(k).type for k in keys] + [pa.string()] * len(data) + [pa.int64()] * len(sums)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, types)],
                                          names=[*keys, *data, *sums])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashes, totals, batch = None, [], [], None
        for batch in batches:
            done = []
            for now, start, end in runs(batch, keys):
                if now != key:
                    if key is not None:
                        done.append((*key, *(h.hexdigest() for h in hashes), *totals))
                    key, hashes, totals, first = now, [hashlib.sha256() for _ in data], [0] * len(sums), True
                for h, name in zip(hashes, data):
                    pieces = batch.column(name).slice(start, end - start).to_pylist()
                    h.update((b"" if first else between) + between.join(pieces))
                first = False
                for i, name in enumerate(sums):
                    totals[i] += sum(batch.column(name).slice(start, end - start).to_pylist())
            yield flush(done, batch)
        if key is not None:
            yield flush([(*key, *(h.hexdigest() for h in hashes), *totals)], batch)
    return run


def digest_in_order(pieces: DataFrame, keys: list[str], order: list[str], data: list[str],
                    sums: list[str] | None = None, between: bytes = b"") -> DataFrame:
    """One row per key: SHA-256 (lowercase hex) of each binary column of ``data``, and the sums.

    Pieces are joined by ``between`` in the sequence of ``order``; a null key is a
    key like others.
    """
    sums = sums or []
    schema = StructType([pieces.schema[k] for k in keys] + [StructField(c, StringType()) for c in data]
                        + [StructField(c, LongType()) for c in sums])
    return (pieces.select(*keys, *order, *data, *sums).repartition(*keys).sortWithinPartitions(*keys, *order)
            .select(*keys, *data, *sums).mapInArrow(_digests(keys, data, sums, between), schema))
