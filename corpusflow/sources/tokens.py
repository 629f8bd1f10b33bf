"""Token streams as a Spark data source: ``uint16`` files with a committed manifest, read by position.

``token_stream`` reads and writes folders ``<root>/<split>/<domain>/<first position>-<version>.bin`` of little-endian ``uint16`` ids.
``<root>/manifest.parquet`` names the files of the one visible version: a job writes files under names of its own, and its
commit replaces the manifest by a rename and then removes what it no longer names. A job that fails leaves the
version before it as it was. The reader plans byte ranges from the manifest: filters on split, domain and ``pos`` are pushed
down, so a slice of a stream costs the bytes of that slice.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from corpusflow.functions.arrow import packed_ids, unpacked_ids
from corpusflow.session import tasks_for
from corpusflow.sources import fs

UINT16_MAX = 65535
PIECE, PARTITION_TOKENS, FILE_TOKENS = 1 << 16, 1 << 23, 1 << 22
TASK_TOKENS = 1 << 22  # that a task reads of small files
MANIFEST = "manifest.parquet"
ENTRY = pa.schema(
    [("split", pa.string()), ("domain", pa.string()), ("first_pos", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.string())]
)
PIECES = "split string, domain string, pos long, n_tokens long, ids array<int>"


def read_manifest(root: str) -> pa.Table:
    """(split, domain, first_pos, n_tokens, file) of the visible version; empty where there is none."""
    store, path = fs.resolve(posixpath.join(root, MANIFEST))
    if store.get_file_info(path).type == pafs.FileType.NotFound:
        return ENTRY.empty_table()
    with store.open_input_file(path) as f:
        return pq.read_table(f)


@dataclass
class ByteRange(InputPartition):
    """``n`` ids of a file from its id ``skip`` on, which is position ``pos`` of the stream."""

    split: str | None
    domain: str | None
    file: str
    pos: int
    skip: int
    n: int


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[ByteRange]

    @property
    def n(self) -> int:
        return sum(r.n for r in self.ranges)


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.piece = int(options.get("piece_len", PIECE))
        self.names: dict[str, set] = {}
        self.low, self.high = 0, 2**63 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what narrows split, domain and pos; Spark checks all filters again."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("split", "domain") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names[name] = self.names.get(name, values) & values
            elif name == "pos" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = int(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, v - isinstance(f, LessThan))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Runs of pieces of the files that can hold a wanted position; a piece starts at a multiple of its length or with its file.

        A task takes as many runs as make up ``TASK_TOKENS``: small files do not cost a task each.
        """
        out: list[ByteRanges] = []
        held = TASK_TOKENS
        for e in read_manifest(self.root).to_pylist():
            if any(e[c] not in values for c, values in self.names.items()):
                continue
            first, end = e["first_pos"], e["first_pos"] + e["n_tokens"]
            start = first if self.low <= first else -(-self.low // self.piece) * self.piece
            stop = min(end, (self.high // self.piece + 1) * self.piece) if self.high >= first else first
            step = max(self.piece, PARTITION_TOKENS // self.piece * self.piece)
            while start < stop:
                until = min(stop, (start // self.piece) * self.piece + step)
                if held + until - start > TASK_TOKENS:
                    out.append(ByteRanges([]))
                    held = 0
                out[-1].ranges.append(ByteRange(e["split"], e["domain"], e["file"], start, start - first, until - start))
                held += until - start
                start = until
        return out

    def read(self, partition: ByteRanges | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, ByteRanges):
            for part in partition.ranges:
                yield self._pieces(part)

    def _pieces(self, partition: ByteRange) -> pa.RecordBatch:
        store, path = fs.resolve(posixpath.join(self.root, partition.file))
        with store.open_input_file(path) as f:
            f.seek(2 * partition.skip)
            ids = np.frombuffer(f.read(2 * partition.n), "<u2").astype(np.int32)
        if len(ids) != partition.n:
            raise ValueError(f"{path}: {len(ids)} of {partition.n} ids from id {partition.skip}")
        pos = partition.pos
        first = pos // self.piece * self.piece
        starts = np.maximum(np.arange(first, pos + len(ids), self.piece, dtype=np.int64), pos)
        cuts = np.append(starts - pos, len(ids))
        n = len(starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.split] * n, pa.string()), pa.array([partition.domain] * n, pa.string()), pa.array(starts),
                pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
            ],
            names=["split", "domain", "pos", "n_tokens", "ids"],
        )


@dataclass
class Written(WriterCommitMessage):
    entries: list = field(default_factory=list)


class TokenWriter(DataSourceArrowWriter):
    """Rows (split, domain, block_id, ids), sorted within tasks, to files that end at multiples of ``file_tokens``."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.block_len = int(options["block_len"])
        self.file_tokens = int(options.get("file_tokens", FILE_TOKENS))
        self.version = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        message, here, held, first, end = Written(), None, [], 0, 0
        attempt = uuid.uuid4().hex[:8]

        def close():
            if not held:
                return
            folder = posixpath.join(*("_null" if v is None else quote(v, safe="") or "_empty" for v in here))
            name = posixpath.join(folder, f"{first:015d}-{self.version}-{attempt}.bin")
            fs.write_atomic(posixpath.join(self.root, name), b"".join(held))
            message.entries.append((*here, first, end - first, name))
            held.clear()

        for batch in iterator:
            splits, domains, blocks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("split", "domain", "block_id"))
            lists = batch.column(batch.schema.get_field_index("ids"))
            for i, (split, domain, block) in enumerate(zip(splits, domains, blocks)):
                ids = np.asarray(lists[i].values)
                if ids.size and (ids.max() > UINT16_MAX or ids.min() < 0):
                    raise ValueError("token id outside uint16 range")
                pos = block * self.block_len
                if here != (split, domain) or pos != end or pos // self.file_tokens != first // self.file_tokens:
                    close()
                    here, first = (split, domain), pos
                held.append(ids.astype("<u2").tobytes())
                end = pos + len(ids)
        close()
        return message

    def commit(self, messages: list) -> None:
        entries = [] if self.overwrite else [tuple(e.values()) for e in read_manifest(self.root).to_pylist()]
        entries += [e for m in messages if m is not None for e in m.entries]
        entries.sort(key=lambda e: (e[0] or "", e[1] or "", e[0] is None, e[1] is None, e[2]))
        for a, b in zip(entries, entries[1:]):
            if a[:2] == b[:2] and b[2] < a[2] + a[3]:
                self.abort(messages)
                raise ValueError(f"two files hold position {b[2]} of stream {b[:2]}")
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*entries), ENTRY)], schema=ENTRY) if entries else ENTRY.empty_table()
        data = io.BytesIO()
        pq.write_table(table, data)
        fs.write_atomic(posixpath.join(self.root, MANIFEST), data.getvalue())
        self._remove(lambda name, kept={e[4] for e in entries}: name not in kept)

    def abort(self, messages: list) -> None:
        self._remove(lambda name: f"-{self.version}-" in name)

    def _remove(self, unwanted) -> None:
        """Data files of this folder that are not wanted."""
        store, root = fs.resolve(self.root)
        for info in store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
            name = posixpath.relpath(info.path, root)
            if info.type == pafs.FileType.File and name.count("/") == 2 and name.endswith(".bin") and unwanted(name):
                store.delete_file(info.path)


class TokenStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


def read_token_stream(spark: SparkSession, path: str, piece_len: int = PIECE) -> DataFrame:
    """Located pieces (split, domain, ``pos``, ``n_tokens``, ``ids``) of the committed streams below ``path``.

    ``where`` on split, domain and ``pos`` reads only the pieces that it can match.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenStream)
    return spark.read.format("token_stream").option("piece_len", piece_len).load(fs.qualify(spark, path))


def write_token_stream(blocks: DataFrame, path: str, block_len: int, blocks_per_file: int = 8192, append: bool = False) -> DataFrame:
    """Write streams of a block table and commit them; returns the manifest (split, domain, file_id, first_pos, n_tokens, file).

    A file holds at most ``blocks_per_file`` blocks, so a task never holds more tokens. An id above 65535 fails the job, and
    what was visible before stays so. ``append`` adds to the visible streams, else they are replaced.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(TokenStream)
    n = tasks_for(spark, blocks.count() * block_len)
    rows = blocks.where(F.size("ids") > 0).select(
        "split", "domain", F.floor(F.col("block_id") / blocks_per_file).alias("file_id"), "block_id", packed_ids("ids").alias("ids")
    )
    rows = rows.repartitionByRange(n, "split", "domain", "file_id").sortWithinPartitions("split", "domain", "block_id")
    root = fs.qualify(spark, path)
    writer = rows.select("split", "domain", "block_id", unpacked_ids("ids").alias("ids")).write.format("token_stream").mode("append" if append else "overwrite")
    writer.option("block_len", block_len).option("file_tokens", block_len * blocks_per_file).save(root)
    manifest = spark.read.parquet(posixpath.join(path, MANIFEST))
    return manifest.select(
        "split", "domain", F.floor(F.col("first_pos") / (block_len * blocks_per_file)).alias("file_id"), "first_pos", "n_tokens",
        F.concat(F.lit(path.rstrip("/") + "/"), "file").alias("file"),
    )
