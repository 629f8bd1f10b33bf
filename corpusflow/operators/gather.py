"""Random gather: many single tokens of a stream, drawn independently, without a row per token.

Draws are made a chunk of output positions at a time, as arrays. Each chunk is parted by the source slice
that its positions fall into (a radix partition by the leading digits of the position), so what is
shuffled are packed (position, target) arrays, a row per slice and chunk. A task that holds a slice as one
array serves the chunks that stream past it with a numpy take, and the answers of a chunk meet again in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrow import packed_ids, unpack

#: Tokens of a source slice, and draws of a chunk: more where a stream has so many slices that a chunk would scatter.
SLICE, CHUNK, MOST, PER_SLICE = 1 << 20, 1 << 16, 1 << 22, 64

DRAWS = "stream long, slice long, target long, chunk long, size int, at binary, pos binary"
ANSWERS = "target long, chunk long, size int, at binary, ids binary"


def chunk_size(stream_len: Column, block_len: int) -> Column:
    """Draws of a chunk: a whole number of output blocks."""
    wanted = F.least(F.greatest(F.lit(CHUNK), F.ceil(stream_len / SLICE) * PER_SLICE), F.lit(MOST))
    return F.ceil(wanted / block_len) * block_len


def _by_slice(slice_len: int):
    """(stream, target, chunk, positions) to a row per slice: where in the chunk, and where in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DRAWS.split(", ")]
        for batch in batches:
            rows = []
            streams, targets, chunks = (batch.column(i).to_pylist() for i in range(3))
            for i, (stream, target, chunk) in enumerate(zip(streams, targets, chunks)):
                pos = np.asarray(batch.column(3)[i].values, dtype=np.int64)
                part = pos // slice_len
                order = np.argsort(part, kind="stable").astype(np.int32)
                part = part[order]
                inside = (pos[order] - part * slice_len).astype(np.int32)
                edges = np.flatnonzero(np.diff(part)) + 1
                for a, b in zip([0, *edges], [*edges, len(pos)]):
                    if a < b:
                        rows.append((stream, int(part[a]), target, chunk, len(pos), order[a:b].tobytes(), inside[a:b].tobytes()))
            if rows:
                types = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run

def _take(block_len: int, slice_len: int):
    """Blocks of a slice, then the draws that fall into it, slice by slice, to the drawn ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, np.zeros(slice_len, np.int32)
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = list(zip(col["stream"].to_pylist(), col["slice"].to_pylist()))
            starts, sizes, chunks, targets = (col[n].to_pylist() for n in ("start", "size", "chunk", "target"))
            out = []
            for i, key in enumerate(keys):
                if key != here:
                    here = key
                    held[:] = -1
                if starts[i] is not None:
                    ids, _ = unpack(col["ids"].slice(i, 1))
                    # a block may begin before its slice or end behind it
                    lo, hi = max(0, -starts[i]), min(len(ids), slice_len - starts[i])
                    held[starts[i] + lo : starts[i] + hi] = ids[lo:hi]
                    continue
                pos = np.frombuffer(col["pos"][i].as_buffer(), np.int32)
                out.append((targets[i], chunks[i], sizes[i], col["at"][i].as_py(), held[pos].tobytes()))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                names = [c.split()[0] for c in ANSWERS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _place(block_len: int):
    """The answers of a chunk as its output blocks, numbered from the chunk's first."""

    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        ids = np.empty(size, np.int32)
        for at, got in zip(rows.column("at"), rows.column("ids")):
            ids[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(got.as_buffer(), np.int32)
        cuts = np.append(np.arange(0, size, block_len), size).astype(np.int32)
        n = len(cuts) - 1
        target, chunk = rows.column("target")[0].as_py(), rows.column("chunk")[0].as_py()
        return pa.table(
            {
                "target": pa.array([target] * n, pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()),
                "nth": pa.array(range(n), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids)),
            }
        )

    return run


def gather_tokens(
    blocks: DataFrame, draws: DataFrame, block_len: int, slice_len: int = SLICE, parts: int | None = None
) -> DataFrame:
    """(target, chunk, nth, ids): the output blocks of every chunk of draws.

    ``blocks`` has (stream, block_id, ids) of a block table, ``draws`` (stream, target, chunk, ``positions`` array<long>). A
    block that straddles two slices goes to both. Blocks are shuffled packed, to ``parts`` tasks. No group is collected but
    the answers of a chunk.
    """
    parts = parts or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = draws.select("stream", "target", "chunk", "positions").mapInArrow(_by_slice(slice_len), DRAWS)
    first = F.col("block_id") * block_len
    reach = F.sequence(F.floor(first / slice_len), F.floor((first + F.size("ids") - 1) / slice_len))
    source = blocks.where(F.size("ids") > 0).select("stream", F.explode(reach).alias("slice"), first.alias("first"), "ids")
    source = source.select("stream", "slice", (F.col("first") - F.col("slice") * slice_len).cast("int").alias("start"), packed_ids("ids").alias("ids"))
    work = source.unionByName(asked, allowMissingColumns=True)
    work = work.repartition(parts, "stream", "slice").sortWithinPartitions("stream", "slice", F.col("start").asc_nulls_last())
    answers = work.mapInArrow(_take(block_len, slice_len), ANSWERS)
    return answers.groupBy("target", "chunk").applyInArrow(_place(block_len), "target long, chunk long, nth long, ids array<int>")
