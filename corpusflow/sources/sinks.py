"""Sinks: JSONL, flat uint16 token files, build-once materialisation, archives."""

from __future__ import annotations

import io
import posixpath
import tarfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources import fs
from corpusflow.sources.tokens import write_token_stream


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines (nested structs stay nested)."""
    df.write.mode(mode).json(path)


def write_token_bin(
    blocks: DataFrame, path: str, block_len: int, blocks_per_file: int = 256
) -> DataFrame:
    """Write each stream as little-endian ``uint16`` files of contiguous blocks and commit them.

    A file holds at most ``blocks_per_file`` blocks, so a task never holds more
    than ``blocks_per_file * block_len`` tokens whatever the stream length. An id above
    65535 fails the job, which then leaves what was visible before. Returns the manifest (one row per
    file); see :mod:`corpusflow.sources.tokens`.
    """
    return write_token_stream(blocks, path, block_len, blocks_per_file)


def _complete_builds(path: str, spark: SparkSession) -> list[str]:
    """Complete builds below ``path``, the earliest first."""
    found = fs.matching(spark, posixpath.join(path, "build-*", "_SUCCESS"))
    return [posixpath.dirname(p) for _, p in sorted(found)]


def materialise_once(build: Callable[[], DataFrame], path: str, spark: SparkSession) -> DataFrame:
    """Build a table only if a complete copy is not there yet; then load it.

    Every builder writes a folder of its own below ``path``, and all take the earliest complete one: drivers that race
    never overwrite each other, and a half-written folder (a killed job) is neither trusted nor in the way.
    """
    if not _complete_builds(path, spark):
        build().write.mode("errorifexists").parquet(posixpath.join(path, f"build-{uuid.uuid4().hex}"), compression="zstd")
    return spark.read.parquet(_complete_builds(path, spark)[0])


ARCHIVE_RESULT = "archive string, n_members long"


def write_archives(
    df: DataFrame, path: str, name_col: str, content_col: str, max_members: int = 10000, max_bytes: int = 64_000_000
) -> DataFrame:
    """Pack rows into ``.tar.gz`` archives (one or more per task, at most ``max_members`` or about ``max_bytes`` each).

    Returns one row per archive written; evaluated lazily like any DataFrame.
    Evaluate it once (or persist it): a second evaluation rewrites the same
    archive names with the same content.
    """
    root, shown = fs.qualify(df.sparkSession, path), path.rstrip("/")
    sel = df.select(F.col(name_col).cast("string").alias("n"), F.col(content_col).alias("c"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        buf, tar, count, written = None, None, 0, []

        def close():
            tar.close()
            # named by partition and chunk: a retried task overwrites, never duplicates
            name = f"part-{part:05d}-{len(written):05d}.tar.gz"
            fs.write_atomic(posixpath.join(root, name), buf.getvalue())
            written.append((posixpath.join(shown, name), count))

        for pdf in batches:
            for n, c in zip(pdf["n"], pdf["c"]):
                if tar is None:
                    buf = io.BytesIO()
                    tar = tarfile.open(fileobj=buf, mode="w:gz")
                    count = 0
                data = (c or "").encode("utf-8")
                info = tarfile.TarInfo(name=n)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                count += 1
                if count >= max_members or buf.tell() >= max_bytes:
                    close()
                    tar = None
        if tar is not None:
            close()
        yield pd.DataFrame(written, columns=["archive", "n_members"])

    return sel.mapInPandas(pack, ARCHIVE_RESULT)
