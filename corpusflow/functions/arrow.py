"""Arrow batch kernels for the few steps Spark has no native vectorised form for.

Spark's higher-order functions (``transform``, ``aggregate``) are evaluated
element by element outside whole-stage codegen; for per-token work over
whole corpora an Arrow batch kernel (one numpy operation over the values
buffer of a whole batch, offsets kept as they are) is several times faster.
Every kernel here is vectorised over the batch: no per-row Python loop,
except where a tokeniser library call is per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

# Return types as objects: DDL strings would need a live session at import.
INT_ARRAY = ArrayType(IntegerType())

# Character id of each byte (newline 0, printable ASCII 1-95).
_CHAR_LUT = np.full(256, -1, dtype=np.int32)
_CHAR_LUT[10] = 0
_CHAR_LUT[32:127] = np.arange(1, 96, dtype=np.int32)
_CHAR_INV = np.zeros(96, dtype=np.uint8)
_CHAR_INV[0] = 10
_CHAR_INV[1:] = np.arange(32, 127, dtype=np.uint8)


def _dense(a: pa.Array) -> pa.Array:
    """A copy without a slice offset, so buffers can be read directly."""
    return pa.concat_arrays([a]) if a.offset else a


def _string_parts(s: pa.Array):
    s = _dense(pc.fill_null(s, "").cast(pa.string()))
    off = np.frombuffer(s.buffers()[1], dtype=np.int32, count=len(s) + 1)
    buf = s.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return off, data[off[0]:off[-1]], off - off[0]


def _list_parts(a: pa.Array):
    a = _dense(a)
    off = np.asarray(a.offsets, dtype=np.int64)
    vals = a.values.to_numpy(zero_copy_only=False) if len(a.values) else np.zeros(0, np.int64)
    return vals[off[0]:off[-1]], off - off[0]


#: Tokens (or characters) that a kernel works on at a time, so that its memory does not follow the batch.
STEP = 1 << 20


def row_steps(off: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows (a, b) that hold at most ``most`` values by their offsets; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b
        a = b


@arrow_udf(INT_ARRAY)
def char_ids_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Character ids of texts already reduced to the 96-symbol alphabet (ASCII)."""
    for clean in batches:
        _, data, rel = _string_parts(clean)
        for a, b in row_steps(rel):
            ids = _CHAR_LUT[data[rel[a] : rel[b]]]
            yield pa.ListArray.from_arrays(pa.array(rel[a : b + 1] - rel[a], pa.int32()), pa.array(ids, pa.int32()))


def pack(vals: np.ndarray, off: np.ndarray) -> pa.Array:
    """Lists of ids as bytes: the width that the largest id of all needs (1, 2 or 4), then the ids, little-endian."""
    low, high = (int(vals.min()), int(vals.max())) if len(vals) else (0, 0)
    width = 4 if low < 0 or high > 0xFFFF else 2 if high > 0xFF else 1
    kind = {1: "<u1", 2: "<u2", 4: "<i4"}[width]
    n = len(off) - 1
    at = off.astype(np.int64) * width + np.arange(n + 1)
    if at[-1] >= 2**31:
        raise ValueError("a batch of 2**31 bytes or more: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out, body = np.empty(at[-1], np.uint8), np.ones(at[-1], bool)
    out[at[:-1]], body[at[:-1]] = width, False
    out[body] = vals.astype(kind).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of lists made by :func:`pack`, which need not have one width."""
    packed = _dense(packed)
    n = len(packed)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    at = np.frombuffer(packed.buffers()[1], np.int32, count=n + 1).astype(np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    width = data[at[:-1]].astype(np.int64)
    off = np.concatenate([[0], np.cumsum((np.diff(at) - 1) // width)])
    kinds = {1: "<u1", 2: "<u2", 4: "<i4"}
    if (width == width[0]).all():
        body = np.ones(len(data), bool)
        body[at[:-1]] = False
        return data[body].view(kinds[int(width[0])]).astype(np.int32), off
    ids = np.empty(off[-1], np.int32)
    for i in range(n):
        ids[off[i] : off[i + 1]] = data[at[i] + 1 : at[i + 1]].copy().view(kinds[int(width[i])])
    return ids, off


@arrow_udf(BinaryType())
def packed_ids(ids: pa.Array) -> pa.Array:
    """Lists of ids as bytes (:func:`pack`): what is shuffled of a token is a byte or two, not four. A null list is an empty one."""
    vals, off = _list_parts(ids)
    return pack(vals, off)


@arrow_udf(INT_ARRAY)
def unpacked_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Inverse of :func:`packed_ids`."""
    for packed in batches:
        at = np.concatenate([[0], np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False), dtype=np.int64)])
        for a, b in row_steps(at):
            vals, off = unpack(packed.slice(a, b - a))
            yield pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(vals, pa.int32()))


@arrow_udf(INT_ARRAY)
def joined_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Lists of packed lists: the ids of each, one list after the other."""
    for lists in batches:
        lists = _dense(lists)
        outer = np.asarray(lists.offsets, dtype=np.int64)
        sizes = pc.binary_length(lists.values).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[outer]
        for a, b in row_steps(at):
            vals, off = unpack(lists.values.slice(outer[a], outer[b] - outer[a]))
            yield pa.ListArray.from_arrays(pa.array(off[outer[a : b + 1] - outer[a]], pa.int32()), pa.array(vals, pa.int32()))


@arrow_udf(StringType())
def char_decode_batch(ids: pa.Array) -> pa.Array:
    """Inverse of :func:`char_ids_batch`."""
    vals, rel = _list_parts(ids)
    data = _CHAR_INV[vals.astype(np.int64)]
    return pa.StringArray.from_buffers(len(rel) - 1, pa.py_buffer(rel.astype(np.int32)), pa.py_buffer(data.tobytes()))


IDS_STATS = StructType([StructField(n, LongType()) for n in ("n_tokens", "first_id", "last_id", "checksum")])


@arrow_udf(IDS_STATS)
def ids_stats(ids: pa.Array) -> pa.Array:
    """Per list: size, first, last and the positional checksum sum((i+1)*(id+1))."""
    vals, off = _list_parts(ids)
    steps = [_stats(vals[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in row_steps(off)]
    return pa.concat_arrays(steps) if steps else pa.array([], _STATS)


_STATS = pa.struct([(n, pa.int64()) for n in ("n_tokens", "first_id", "last_id", "checksum")])


def _stats(vals: np.ndarray, off: np.ndarray) -> pa.Array:
    vals = vals.astype(np.int64)
    n = np.diff(off)
    pos = np.arange(len(vals), dtype=np.int64) - np.repeat(off[:-1], n)
    w = (pos + 1) * (vals + 1)
    csum = np.concatenate([[0], np.cumsum(w)])
    checksum = csum[off[1:]] - csum[off[:-1]]
    has = n > 0
    safe = np.zeros(0, np.int64) if len(vals) == 0 else vals
    first = np.where(has, safe[np.minimum(off[:-1], max(len(vals) - 1, 0))] if len(vals) else 0, 0)
    last = np.where(has, safe[np.maximum(off[1:] - 1, 0)] if len(vals) else 0, 0)
    mask = ~has
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()),
            pa.array(first, pa.int64(), mask=mask),
            pa.array(last, pa.int64(), mask=mask),
            pa.array(checksum, pa.int64()),
        ],
        names=["n_tokens", "first_id", "last_id", "checksum"],
    )


def lists_from_numpy(chunks: list[np.ndarray], dtype=pa.int32()) -> pa.Array:
    """Build a ListArray from per-row numpy arrays with one concatenation."""
    lens = np.fromiter((len(c) for c in chunks), dtype=np.int64, count=len(chunks))
    off = np.zeros(len(chunks) + 1, dtype=np.int64)
    np.cumsum(lens, out=off[1:])
    vals = np.concatenate(chunks).astype(np.int32) if chunks else np.zeros(0, np.int32)
    if off[-1] >= 2**31:
        raise ValueError("a batch of 2**31 ids or more: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(vals, dtype))


_HEX = np.frombuffer(b"0123456789ABCDEF", dtype=np.uint8)


@arrow_udf(StringType())
def ids_md5(ids: pa.Array) -> pa.Array:
    """md5 of the ids written as 4 upper-case hex digits each (a checkable fingerprint)."""
    import hashlib

    vals, off = _list_parts(ids)
    out = []
    for first, last in row_steps(off):
        v = vals[off[first] : off[last]].astype(np.int64)
        if len(v) and (v.min() < 0 or v.max() > 0xFFFF):
            raise ValueError("an id does not fit in four hex digits")
        raw = np.stack([_HEX[(v >> s) & 15] for s in (12, 8, 4, 0)], axis=1).tobytes()
        at = 4 * (off[first : last + 1] - off[first])
        out += [hashlib.md5(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
    return pa.array(out, pa.string())
