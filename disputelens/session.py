"""Session settings and the few driver-side helpers the jobs share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job assumes. Times are UTC wall clock in TIMESTAMP_NTZ and
# the helpers do calendar arithmetic on them; the UTC session zone keeps any
# TIMESTAMP a user derives consistent with that.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: Stored input bytes per shuffle partition at most, so that a task's sort fits its memory.
BYTES_PER_PARTITION = 16 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SIZED: dict[str, str] = {}


def partitions_for(spark: SparkSession, input_bytes: int) -> int:
    """Shuffle partitions for an input of that size: the session's number, or more if it is large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // BYTES_PER_PARTITION))


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles start with partitions for the input's size, which Spark then merges at run time.

    With a fixed number a partition grows with the input until each sort spills. A
    number that the user has set stays.
    """
    app = spark.sparkContext.applicationId
    if spark.conf.get(_INITIAL, None) not in (None, _SIZED.get(app)):
        return
    _SIZED[app] = str(partitions_for(spark, input_bytes))
    spark.conf.set(_INITIAL, _SIZED[app])


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "disputelens", driver_memory: str | None = None) -> SparkSession:
    """A session with ``SESSION_CONF``. ``driver_memory`` matters in local mode
    only, where the driver JVM also runs every task; it applies when this call
    starts the JVM."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for materialised tables and checkpoints.

    On a cluster the folder named by ``spark.checkpoint.dir`` is used as is.
    Only a local-mode session without that setting (tests) gets a fresh
    folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="disputelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[str, list] = {}
_FREEING_LOCK = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that end within the block delete their shuffle files, on all executors.

    Otherwise the files stay until the driver's JVM happens to collect the plan, and a job of several
    writes holds the shuffles of all of them. For queries that run once, such as a write.
    """
    app = spark.sparkContext.applicationId
    with _FREEING_LOCK:
        users = _FREEING.setdefault(app, [])
        users.append(spark.conf.get(_FREE, "false"))
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _FREEING_LOCK:
            # the setting that the first user found comes back with the last one
            if len(users) == 1:
                spark.conf.set(_FREE, users.pop())
            else:
                users.pop()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a parquet table in the shared checkpoint folder.

    Used for relations that later steps read several times (the report's
    base, the derived warehouse relations) and to have the shuffles of one step
    deleted before the next. The table survives lost executors,
    unlike ``persist`` or a local checkpoint, and reading it back keeps column
    pruning, row-group filtering and the vectorised reader, which a
    ``DataFrame.checkpoint`` (serialised rows) would lose.
    """
    return df.sparkSession.read.parquet(_store(df))


def _store(df: DataFrame) -> str:
    spark = df.sparkSession
    path = f"{_tables_root(spark)}/{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside this application's materialised tables (gone with ``drop_materialized``)."""
    return f"{_tables_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def materialized(df: DataFrame):
    """``materialize`` for the length of a job: the table is deleted when the block ends."""
    spark = df.sparkSession
    path = _store(df)
    try:
        yield spark.read.parquet(path)
    finally:
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def _tables_root(spark: SparkSession) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tables/{spark.sparkContext.applicationId}"


def drop_materialized(spark: SparkSession) -> None:
    """Delete this application's materialised tables from the checkpoint folder.

    Call it when the session's work is done: DataFrames read from those
    tables stop working afterwards.
    """
    delete_path(spark, _tables_root(spark))
    # forget the relations that were read from them
    from disputelens.plans import registry
    from disputelens.sources import fixtures

    app = spark.sparkContext.applicationId
    for cache in (fixtures._BASES, registry._FIXTURES):
        for key in [k for k in cache if k[0] == app]:
            del cache[key]
