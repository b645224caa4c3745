"""Fact tables stored in buckets of their join keys, so that the report's fact joins need no shuffle.

The settled transactions, disputes and authorisations meet on (user, code). Each is
stored in the same number of buckets of these two columns, by the hash that Spark's
joins use; a join of two such tables reads bucket against bucket. The code is part of
the key on purpose: in buckets of the user alone, an account with a third of all rows
would be one task, and a join without an exchange leaves nothing to split at run time.
Rows without a code lie with those of the same user.

The number of buckets is fixed when the tables are written; choose it so that a bucket
of the largest table fits a task (100 TB: some 100,000 to 200,000).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: relation -> the columns of its buckets, in the order of the joins
LAYOUT = {
    "settled_txn": ("user_id", "authorization_code"),
    "disputed_txn": ("user_id", "authorization_code"),
    "auth_event": ("user_id", "auth_id"),
}


def write_bucketed(df: DataFrame, table: str, path: str, keys: tuple[str, ...], buckets: int) -> None:
    """Create or replace ``table`` over ``path``: one file per bucket, sorted by ``keys``.

    The shuffle before the write uses the buckets' own hash, so each task writes one bucket.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table))


class BucketedSources:
    """``sources`` with the relations of ``LAYOUT`` read from their bucketed tables; the others as they are."""

    def __init__(self, spark: SparkSession, sources, prefix: str):
        self._spark, self._sources, self._prefix = spark, sources, prefix

    @classmethod
    def store(cls, spark: SparkSession, sources, folder: str, prefix: str, buckets: int) -> "BucketedSources":
        """Write the tables ``<prefix>_<relation>`` under ``folder`` and read from them."""
        for name, keys in LAYOUT.items():
            write_bucketed(getattr(sources, name), f"{prefix}_{name}", f"{folder}/{name}", keys, buckets)
        return cls(spark, sources, prefix)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.table(f"{self._prefix}_{name}") if name in LAYOUT else getattr(self._sources, name)

    def drop(self) -> None:
        """Forget the tables; their files stay until the folder is deleted."""
        for name in LAYOUT:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._prefix}_{name}")
