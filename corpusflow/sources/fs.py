"""File access outside Spark's readers and writers.

The driver resolves paths as Spark does (``qualify``: default file system, any scheme that Hadoop knows);
tasks open the resulting URIs through pyarrow's file systems. A scheme that pyarrow lacks is an error,
never a silent write to an executor's own disk.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

#: Hadoop's names of stores that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def qualify(spark: SparkSession, path: str) -> str:
    """The full URI of ``path``; without a scheme it is on the session's default file system."""
    store, where = _hadoop(spark, path)
    return store.makeQualified(where).toString().rstrip("/")


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether the file system that Spark would use has ``path``."""
    store, where = _hadoop(spark, path)
    return store.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[tuple[int, str]]:
    """(modification time, path) of what a glob pattern matches on the file system that Spark would use."""
    store, where = _hadoop(spark, pattern)
    return [(s.getModificationTime(), s.getPath().toString()) for s in store.globStatus(where) or []]


def resolve(path: str):
    """(pyarrow file system, path inside it) of a URI or an absolute local path."""
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    scheme, colon, rest = path.partition(":")
    if not colon:
        raise ValueError(f"{path!r} is neither a URI nor an absolute path")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def write_atomic(path: str, data: bytes) -> None:
    """Write to a temporary name, then rename: a retried task never leaves half a file."""
    fs, p = resolve(path)
    fs.create_dir(posixpath.dirname(p), recursive=True)
    tmp = f"{p}.tmp-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, p)
