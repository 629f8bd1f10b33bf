"""Texts of an Arrow batch as flat byte arrays, for numpy kernels that work on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, max_bytes: int = 1_000_000, max_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``max_bytes`` bytes (and ``max_rows`` rows); a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > max_bytes or i - start == max_rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def pieces(text: str, max_chars: int) -> Iterator[tuple[str, int, int]]:
    """Parts of a text with a character more on either side where there is one: (part, more before, more after)."""
    for at in range(0, len(text), max_chars):
        before, after = int(at > 0), int(at + max_chars < len(text))
        yield text[at - before : at + max_chars + after], before, after


def tidy(run):
    """``run`` over Arrow batches; a worker goes on to other tasks, so Arrow's free memory is given back at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the runs of non-space bytes in each text."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word ends where its text does
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal ids for equal spans. Spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.empty(2 * len(starts), dtype=np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    both = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers)  # spans and what is between them
    return np.asarray(both.dictionary_encode().indices, dtype=np.int64)[0::2]
