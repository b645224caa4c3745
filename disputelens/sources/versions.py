"""Create-or-replace of several tables at once: versions in a folder, and a file that names the current one.

A version's tables are written to a folder of their own. When all are complete, a
pointer file is written beside the old one and renamed over it, which Hadoop's
FileContext does in one step. Readers see the old tables or the new ones, never a
mixture, and a lost writer leaves the old ones. Folders that no pointer names are
deleted when the next version is current, but for the one before it, which
running readers may hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

POINTER = "_current"


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_name(spark, folder: str) -> str | None:
    """The version that the pointer names; None without one."""
    jvm, p, fs = _fs(spark, f"{folder}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current_version(spark, folder: str) -> str:
    """The folder of the current version."""
    name = current_name(spark, folder)
    if name is None:
        raise FileNotFoundError(f"no complete version in {folder}")
    return f"{folder}/{name}"


@contextmanager
def new_version(spark, folder: str) -> Iterator[str]:
    """A folder for the next version; it becomes the current one when the block ends without an error."""
    before = current_name(spark, folder)
    name = f"version-{uuid.uuid4().hex}"
    yield f"{folder}/{name}"
    jvm, draft, fs = _fs(spark, f"{folder}/{POINTER}-{name}")
    stream = fs.create(draft, True)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), options)
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
        if status.getPath().getName().startswith("version-") and status.getPath().getName() not in (name, before):
            fs.delete(status.getPath(), True)
