"""Hierarchical packing of documents into windows of several lengths.

A document is tokenised and cut into full windows of the longest tier; what is left of it goes to the
tier of the shortest window that holds it. Tiers are packed from the longest to the shortest: every
window starts with a piece of its own tier, its gap is filled with the longest pieces of shorter tiers
that fit, and what is still open with the head of a piece that is cut there, so windows come out full.
Pieces of equal length are packed together, so a plan takes a step per length and not per document.
Windows are then dealt to step groups of near-equal size.

A task packs its own documents, a bounded number at a time (a cell). A cell leaves at most one window
that is not full, so nothing has to be shuffled: the texts are read once.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusflow.llm.textbytes import flat, slices, tidy

TIERS = (1024, 512, 256, 128)
STEP_WINDOWS = 16  # a step group holds as many tokens as so many windows of the longest tier
CELL_TOKENS = 2_000_000
END_ID = 0
CACHE_ENTRIES = 300_000  # distinct pieces that a task remembers
RUN = 200  # pieces that are encoded together

SCHEMA = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier int, step_id long"
)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(path)


@cache
def _encoder(path: str, entries: int) -> ByteBpe:
    """One per worker process, so that tasks share what it has learned."""
    return ByteBpe(path, entries)


class ByteBpe:
    """Token ids of whole texts by a byte-level BPE tokenizer file.

    Its pre-tokenizer never joins what stands on both sides of a single space between two other
    characters. Texts are cut there, and each distinct piece of a batch that is not known from an
    earlier one is encoded once; of what is known, the most used half stays when there is too much. Pieces that may follow each other in a text are encoded in runs.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one character stands for one byte
        self.forget()

    def forget(self):
        self.known = pa.array([], pa.large_binary())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)
        self.keys, self.place_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of what is known

    def keep_used(self, entries: int):
        """Keep the ``entries`` pieces that slices used most; older uses count half."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:entries])
        ends = np.cumsum(self.sizes)
        starts, sizes = (ends - self.sizes)[keep], self.sizes[keep]
        at = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.arange(sizes.sum()) + np.repeat(starts - at, sizes)]
        self.known, self.sizes, self.uses = self.known.take(pa.array(keep)), sizes, self.uses[keep] // 2
        new = np.full(len(ends), -1, dtype=np.int64)
        new[keep] = np.arange(len(keep))
        place = new[self.place_of]
        self.keys, self.place_of = self.keys[place >= 0], place[place >= 0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id, tokens per text)."""
        data, offsets = flat(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.full(n, END_ID, np.uint32), np.ones(n, np.int64)
        first = _cuts(data)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        bounds = np.append(starts, len(data))
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        place, sizes, ids = self._look_up(pieces.dictionary)
        at = np.cumsum(sizes) - sizes
        piece = place[np.asarray(pieces.indices)]
        lengths = sizes[piece]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(ends[-1]) + np.repeat(at[piece] - ends[:-1], lengths)
        total = np.diff(ends[np.searchsorted(starts, offsets)]) + 1
        out = np.full(int(total.sum()), END_ID, dtype=np.uint32)
        mask = np.ones(len(out), dtype=bool)
        mask[np.cumsum(total) - 1] = False
        out[mask] = ids[take]
        return out, total

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each piece, tokens of each place, their ids)."""
        raw = pieces.to_numpy(zero_copy_only=False)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        if len(self.known) + len(raw) > self.entries:
            self.keep_used(self.entries // 2)
        by_key = np.argsort(keys)  # looking up in order is faster
        at = np.empty(len(raw), dtype=np.int64)
        at[by_key] = np.minimum(np.searchsorted(self.keys, keys[by_key]), len(self.keys) - 1)
        fresh = np.ones(len(raw), dtype=bool)
        place = np.zeros(len(raw), dtype=np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.keys[at] == keys)
            place[maybe] = self.place_of[at[maybe]]
            # Equal hashes only propose: the bytes decide.
            same = pc.equal(self.known.take(pa.array(place[maybe])), pieces.take(pa.array(maybe)))
            fresh[maybe[np.asarray(same)]] = False
        np.add.at(self.uses, place[~fresh], 1)
        new, learned = np.flatnonzero(fresh), len(self.known)
        inner = _joinable(pieces)[new]
        for part, run in ((new[inner], RUN), (new[~inner], 1)):
            if not len(part):
                continue
            place[part] = len(self.known) + np.arange(len(part))
            found = pieces.take(pa.array(part))
            data, bounds = _bytes(found)
            runs = np.append(bounds[:-1:run], bounds[-1])
            joined = [data[i:j].tobytes().decode() for i, j in zip(runs, runs[1:])]
            encoded = []
            for i in range(0, len(joined), 20):  # an encoding holds far more than its ids
                batch = self.tokenizer.encode_batch_fast(joined[i : i + 20], add_special_tokens=False)
                encoded += [np.array(e.ids, dtype=np.uint32) for e in batch]
            ids = np.concatenate(encoded)
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), bounds[1:])
            self.known = pa.concat_arrays([self.known, found])
            self.sizes = np.concatenate([self.sizes, np.diff(last + 1, prepend=0)])
            self.ids = np.concatenate([self.ids, ids])
        added = by_key[fresh[by_key]]
        into = np.searchsorted(self.keys, keys[added])
        self.keys = np.insert(self.keys, into, keys[added])
        self.place_of = np.insert(self.place_of, into, place[added])
        self.uses = np.concatenate([self.uses, np.zeros(len(self.known) - learned, np.int64)])
        return place, self.sizes, self.ids


def _bytes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a large binary array without nulls."""
    _, offsets, data = pieces.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _joinable(pieces: pa.Array) -> np.ndarray:
    """Pieces that are a space and a sure character before anything that ends in a sure one: they may
    follow their like in a text. No piece is empty."""
    data, bounds = _bytes(pieces)
    first, last = bounds[:-1], bounds[1:] - 1
    graph = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data < 0xE0)
    starts = (data[first] == 0x20) & (last > first) & (graph | lead)[np.minimum(first + 1, last)]
    ends = graph[last] | (((data[last] & 0xC0) == 0x80) & lead[np.maximum(last - 1, first)])
    return starts & ends


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a single space between two characters that are surely no white space.

    Sure are visible ASCII and two-byte characters that start with C3 or more; a place missed costs
    only speed.
    """
    graph = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data < 0xE0)
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:] = graph[:-1]
    before[2:] |= lead[:-2]
    after[:-1] = graph[1:] | lead[1:]
    return (data == 0x20) & before & after


def plan(lengths: np.ndarray, tiers: Sequence[int] = TIERS) -> tuple[np.ndarray, ...]:
    """Pieces of documents of ``lengths`` tokens: (document, start, length, sequence, offset, tier).

    Pieces of a document follow each other without a gap; so do those of a sequence.
    """
    longest = tiers[0]
    pieces: list[tuple[np.ndarray, ...]] = []
    sequences = 0

    def emit(docs, starts, size, numbers, offset, tier):
        full = lambda x: np.full(len(docs), x, dtype=np.int64)
        pieces.append((docs, starts, full(size), numbers, full(offset), full(tier)))

    docs = np.arange(len(lengths))
    whole = lengths // longest
    owner = np.repeat(docs, whole)
    if len(owner):
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        emit(owner, nth * longest, longest, np.arange(len(owner)), 0, longest)
        sequences = len(owner)
    rest = lengths - whole * longest
    lots: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for size in np.unique(rest[rest > 0]).tolist():
        own = np.flatnonzero(rest == size)
        lots[size] = [(own, whole[own] * longest)]
    some = np.zeros(longest + 1, dtype=bool)
    some[list(lots)] = True

    def take(size):
        lot = lots[size].pop()
        some[size] = bool(lots[size])
        return lot

    def give(size, lot):
        if len(lot[0]):
            lots.setdefault(size, []).append(lot)
            some[size] = True

    for tier, lower in zip(tiers, [*tiers[1:], 0]):
        while len(own := np.flatnonzero(some[lower + 1 : tier + 1])):
            size = lower + 1 + int(own[-1])
            window, gap = [(size, take(size), size)], tier - size
            while gap:
                if len(fits := np.flatnonzero(some[1 : gap + 1])):
                    used = got = 1 + int(fits[-1])
                elif len(longer := np.flatnonzero(some[gap + 1 :])):
                    got, used = gap + 1 + int(longer[0]), gap
                elif len(window) == 1 and len(window[0][1][0]) > 1:  # only equal pieces are left
                    first = window[0][1]
                    half = len(first[0]) // 2
                    give(size, (first[0][half:], first[1][half:]))
                    window[0] = (size, (first[0][:half], first[1][:half]), size)
                    continue
                else:
                    n = min(len(lot[0]) for _, lot, _ in window)
                    if all(len(lot[0]) == n for _, lot, _ in window):
                        break  # nothing is left to fill the last window
                    for w, (got, (d, s), used) in enumerate(window):  # windows that are not made free their pieces
                        window[w] = (got, (d[:n], s[:n]), used)
                        give(got, (d[n:], s[n:]))
                    continue
                window.append((got, take(got), used))
                gap -= used
            n = min(len(lot[0]) for _, lot, _ in window)
            numbers, offset = np.arange(sequences, sequences + n), 0
            sequences += n
            for got, (d, s), used in window:
                emit(d[:n], s[:n], used, numbers, offset, tier)
                offset += used
                give(got, (d[n:], s[n:]))
                if got > used:
                    give(got - used, (d[:n], s[:n] + used))
    if not pieces:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*pieces))


def step_groups(sizes: np.ndarray, step_tokens: int) -> np.ndarray:
    """A group of each sequence; the largest sequence left always goes to the lightest group."""
    groups = np.zeros(len(sizes), dtype=np.int64)
    loads = [(0, g) for g in range(max(1, -(-int(sizes.sum()) // step_tokens)))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, g = heapq.heappop(loads)
        groups[i] = g
        heapq.heappush(loads, (load + int(sizes[i]), g))
    return groups


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: Sequence[int] = TIERS,
    step_windows: int = STEP_WINDOWS,
    cell_tokens: int = CELL_TOKENS,
    cache_entries: int = CACHE_ENTRIES,
    slice_bytes: int = 1_000_000,
) -> DataFrame:
    """A row per piece: document id, start, length, ``ids`` (little-endian unsigned 32-bit), place in its sequence.

    Every document ends in id 0; a null or empty text is that id alone. Repeated rows are documents of
    their own, null ids pass through, other columns are ignored. A sequence holds ``sequence_tokens``
    of at most ``tier`` tokens; it needs no padding at a power of two, else padding to the longest
    tier. ``step_id`` groups sequences of one cell. A document longer than a cell is a cell of its own.
    ``cache_entries`` (distinct pieces that a worker remembers) and ``slice_bytes`` (texts encoded at a
    time) trade memory for speed; they do not change the result.
    """
    tiers = tuple(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, cell = _encoder(tokenizer, cache_entries), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, slice_bytes):
                tokens, per_text = encoder.encode(texts.slice(a, b - a))
                held.append((ids.slice(a, b - a), tokens, per_text))
                size += len(tokens)
                if size >= cell_tokens:
                    yield from _cell(held, id_col, tiers, step_windows, (task << 40) + (cell << 24))
                    held, size, cell = [], 0, cell + 1
        if held:
            yield from _cell(held, id_col, tiers, step_windows, (task << 40) + (cell << 24))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, {SCHEMA}")


def _cell(held, id_col, tiers, step_windows, first: int) -> Iterator[pa.RecordBatch]:
    ids = pa.concat_arrays([h[0] for h in held])
    tokens, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
    doc, start, length, sequence, offset, tier = plan(lengths, tiers)
    sizes = np.bincount(sequence, weights=length).astype(np.int64)
    steps = step_groups(sizes, step_windows * tiers[0])
    order = np.lexsort((start, doc))  # pieces in this order are the tokens, cut
    doc, start, length, sequence, offset, tier = (x[order] for x in (doc, start, length, sequence, offset, tier))
    bounds = np.concatenate([[0], np.cumsum(length)])
    for a in range(0, len(doc), 50_000):
        s = slice(a, min(a + 50_000, len(doc)))
        part = np.ascontiguousarray(tokens[bounds[s.start] : bounds[s.stop]], dtype="<u4")
        cut = ((bounds[s.start : s.stop + 1] - bounds[s.start]) * 4).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(part)])
        longs = [lengths[doc[s]], first + sequence[s], offset[s], sizes[sequence[s]]]
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(doc[s])),
                pa.array(start[s]),
                pa.array(length[s]),
                data,
                *(pa.array(x, pa.int64()) for x in longs),
                pa.array(tier[s], pa.int32()),
                pa.array(first + steps[sequence[s]]),
            ],
            names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_id"],
        )
