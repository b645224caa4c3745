"""Driver tables: one parquet file per table under an ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class TableSource:
    """Reads driver tables by name.

    Each ``read`` returns a fresh scan with only the requested columns, so the
    parquet reader prunes columns and Catalyst can push the caller's filters.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def size(self, name: str) -> int:
        """Stored bytes of a table, through Spark's file system (0 if it isn't there)."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.select(*columns) if columns else df
