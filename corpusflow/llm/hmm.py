"""Hidden Markov language model: Baum-Welch over the whole corpus, exact likelihoods of whole texts.

Texts become blocks of a few MB with a dictionary of their own, written once, compressed and each in a row group of its
own, so that a task of the JVM holds a few at a time. The words of all blocks are counted in
a table that grows with the corpus and never leaves Spark. A state emits word classes: a word that makes up 1 / FREQUENT of all
training tokens (so there are at most FREQUENT of them) is a class of its own, the others share RARE classes by
their hash; within a class words follow their counts in the corpus, and all unknown words together are one more class.
The model is thus of bounded size and broadcast. In every round of Baum-Welch each task runs forward and
backward over its blocks, and its expected counts are added up across the tasks.

Texts are worked in chunks side by side: the product of a chunk's transition and emission matrices
carries the recursion from chunk to chunk, exactly and scaled, so a long text needs no long loop. A text of several
MB is several pieces; training takes each for a sequence, scoring joins them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.textbytes import SPACE, flat, tidy, words
from corpusflow.session import materialise

STATES, ROUNDS = 5, 6
FREQUENT, RARE = 1 << 16, 1 << 12
#: Part of a state's emissions that follows the classes' shares in the corpus, and how long a state lasts at first.
SHARED, LASTS = 0.02, 0.95
END = " "  # no word holds a space
PIECE_BYTES, BLOCK_BYTES, BLOCK_PIECES = 1_000_000, 4_000_000, 20_000
#: A block's number and a word's code in one long: a million blocks a task, four million words a block.
BLOCK_BITS, CODE_BITS = 20, 22
CHUNK = 128

#: Rows of the word table that a task hands over at a time.
PLACES_BATCH = 1 << 16
#: Parquet options that close a row group, and the pages of its columns, after each block.
ROW_GROUPS = {"parquet.block.size": "1", "parquet.page.size.row.check.min": "1"}

BLOCKS = (
    "block long, n_words int, words binary, seen binary, rare binary, codes binary, starts binary, "
    "doc array<long>, nth array<int>, last array<boolean>, id array<long>, train array<boolean>"
)


def cut(data: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``step`` bytes of a text that end at white space; a longer word is a range of its own."""
    at = 0
    while len(data) - at > step:
        spaces = np.flatnonzero(SPACE[data[at : at + step]])
        if len(spaces):
            end = at + int(spaces[-1]) + 1
        else:
            end = at + step
            while end < len(data) and not SPACE[data[end - 1]]:
                found = np.flatnonzero(SPACE[data[end : end + step]])
                end = end + int(found[0]) + 1 if len(found) else min(end + step, len(data))
        yield at, end
        at = end
    yield at, len(data)


def squeezed(data: np.ndarray) -> bytes:
    """The bytes of ``data`` compressed, behind their number; integers by place, so that the high bytes come together."""
    planes = np.ascontiguousarray(data[:, None].view(np.uint8).T)
    return np.int64(data.nbytes).tobytes() + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def spread(blob, kind) -> np.ndarray:
    """The array of ``kind`` behind :func:`squeezed`."""
    n, kind = int(np.frombuffer(blob, np.int64, 1)[0]), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[8:], n), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def squeezed_words(names: pa.Array) -> bytes:
    """Words (none null) compressed: their ends, then their bytes."""
    data, offsets = flat(names)
    ends = squeezed(offsets[1:].astype("<u4"))
    return np.int64(len(ends)).tobytes() + ends + squeezed(data)


def spread_words(blob) -> pa.Array:
    """The words behind :func:`squeezed_words`."""
    blob = memoryview(blob)
    at = 8 + int(np.frombuffer(blob, np.int64, 1)[0])
    ends, data = spread(blob[8:at], "<u4"), spread(blob[at:], np.uint8)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(pieces: list[np.ndarray], last: list[bool], train: list[bool]):
    """(words, training tokens of each, codes, starts) of a block's pieces; the last piece of a text has its end."""
    data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    data[(data >= 65) & (data <= 90)] += 32
    begin, end, n = words(data, offsets)
    bounds = np.empty(2 * len(begin), dtype=np.int64)
    bounds[0::2], bounds[1::2] = begin, end
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    both = pa.Array.from_buffers(pa.large_binary(), max(len(bounds) - 1, 0), buffers)  # words and what is between them
    found = both.dictionary_encode()
    spans = np.asarray(found.indices, dtype=np.int64)[0::2]
    here = np.zeros(len(found.dictionary), bool)
    here[spans] = True
    codes = (np.cumsum(here) - 1)[spans]
    names = pa.concat_arrays([found.dictionary.filter(pa.array(here)).cast(pa.string()), pa.array([END])])
    ends = np.asarray(last, dtype=np.int64)
    codes = np.insert(codes, np.cumsum(n)[ends > 0], len(names) - 1)
    starts = np.concatenate([[0], np.cumsum(n + ends)])
    learned = codes[np.repeat(np.asarray(train, bool), np.diff(starts))]
    return names, np.bincount(learned, minlength=len(names)), codes, starts


def _blocks(schema: pa.Schema, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks, n_docs = TaskContext.get().partitionId(), 0, 0
        pieces, rows, held = [], [], 0

        def flush():
            nonlocal pieces, rows, held, n_blocks
            names, seen, codes, starts = encode(pieces, [r[2] for r in rows], [r[4] for r in rows])
            rare = np.array([crc32(w.encode()) % RARE for w in names.to_pylist()], "<u2")
            blobs = [squeezed(x) for x in (seen.astype("<u4"), rare, codes.astype("<u4"), starts)]
            cells = [(task << BLOCK_BITS) + n_blocks, len(names), squeezed_words(names), *blobs, *map(list, zip(*rows))]
            n_blocks, pieces, rows, held = n_blocks + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids, train = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (doc, learn) in enumerate(zip(ids, train)):
                text = data[offsets[i] : offsets[i + 1]]
                for nth, (a, b) in enumerate(cut(text, piece_bytes)):
                    pieces.append(text[a:b].copy())
                    rows.append(((task << 40) + n_docs, nth, b == len(text), doc, learn))
                    held += b - a
                    if held >= BLOCK_BYTES or len(rows) >= BLOCK_PIECES:
                        yield flush()
                n_docs += 1
        if rows:
            yield flush()

    return tidy(run)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a block: the word, its place (block and code), and training tokens."""
    for batch in batches:
        for i in range(batch.num_rows):
            names = spread_words(batch.column("words")[i].as_buffer())
            seen = pa.array(spread(batch.column("seen")[i].as_buffer(), "<u4"))
            place = pa.array((batch.column("block")[i].as_py() << CODE_BITS) + np.arange(len(names)))
            rows = pa.RecordBatch.from_arrays([names, place, seen.cast(pa.int32())], names=["word", "place", "seen"])
            for at in range(0, len(names), PLACES_BATCH):
                yield rows.slice(at, PLACES_BATCH)


class Chunks:
    """The tokens of some pieces as chunks that are worked side by side, longest first."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, pieces: np.ndarray, opens: np.ndarray):
        sizes = starts[pieces + 1] - starts[pieces]
        self.n = -(-sizes // CHUNK)  # chunks of each piece
        self.piece = np.repeat(np.arange(len(pieces)), self.n)
        first = np.cumsum(self.n) - self.n
        nth = np.arange(len(self.piece)) - first[self.piece]
        length = np.minimum(CHUNK, sizes[self.piece] - nth * CHUNK)
        order = np.argsort(-length, kind="stable")
        self.at = np.empty(len(order), np.int64)  # place of the chunks in the order of the pieces
        self.at[order] = np.arange(len(order))
        self.first, self.length = first, length[order]
        self.begin = (starts[pieces][self.piece] + nth * CHUNK)[order]
        self.opening = ((nth == 0) & opens[self.piece])[order]
        self.codes = codes
        self.steps = [int(np.searchsorted(-self.length, -t, side="left")) for t in range(CHUNK)]  # chunks longer than t

    def emissions(self, e: np.ndarray, t: int) -> np.ndarray:
        return e.take(self.codes[self.begin[: self.steps[t]] + t], axis=1)

    def products(self, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state by next state by chunk, log of the scale) of each chunk; an opening chunk's first token has no transition."""
        k = len(a)
        m = np.zeros((k, k, len(self.length)))
        m[np.arange(k), np.arange(k)] = 1.0
        scale = np.zeros(m.shape[2])
        for t, n in enumerate(self.steps):
            if not n:
                break
            moved = np.matmul(a.T, m[:, :, :n])
            if t == 0:
                moved = np.where(self.opening[:n], m[:, :, :n], moved)
            moved *= self.emissions(e, t)
            if t % 8 == 7:
                top = moved.max(axis=(0, 1))
                moved /= top
                scale[:n] += np.log(top)
            m[:, :, :n] = moved
        top = m.max(axis=(0, 1))
        return m / top, scale + np.log(top)

    def rounds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pieces, their chunks) for the first chunks of all pieces, then the second ones, and so on."""
        alive, j = np.flatnonzero(self.n > 0), 0
        while len(alive):
            yield alive, self.at[self.first[alive] + j]
            j += 1
            alive = alive[self.n[alive] > j]

    def forward(self, pi: np.ndarray, m: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state weights before each chunk, last weights and log scale of each piece)."""
        now, total = np.repeat(pi[:, None], len(self.n), axis=1), np.zeros(len(self.n))
        before = np.empty((len(pi), len(self.length)))
        for pieces, chunks in self.rounds():
            here = now[:, pieces]
            before[:, chunks] = here
            after = (here[:, None, :] * m[:, :, chunks]).sum(axis=0)
            size = after.sum(axis=0)
            now[:, pieces] = after / size
            total[pieces] += scale[chunks] + np.log(size)
        return before, now, total

    def backward(self, m: np.ndarray) -> np.ndarray:
        """Weights of what follows each chunk, by the state it ends in."""
        now, after = np.ones((len(m), len(self.n))), np.empty((len(m), len(self.length)))
        for pieces, chunks in reversed(list(self.rounds())):
            here = now[:, pieces]
            after[:, chunks] = here
            before = (m[:, :, chunks] * here).sum(axis=1)
            now[:, pieces] = before / before.max(axis=0)
        return after


def expected(codes, starts, pieces, pi, a, e):
    """Baum-Welch counts of some pieces, each a sequence, by emissions ``e`` (state by code).

    Returned are (counts by state and code, transitions, first states).
    """
    c = Chunks(codes, starts, pieces, np.ones(len(pieces), bool))
    k = len(pi)
    m, scale = c.products(a, e)
    before, _, _ = c.forward(pi, m, scale)
    beta = c.backward(m)
    del m
    alphas, now = [], before
    for t, n in enumerate(c.steps):
        if not n:
            break
        moved = a.T @ now[:, :n]
        if t == 0:
            moved = np.where(c.opening[:n], now[:, :n], moved)
        moved *= c.emissions(e, t)
        now = moved / moved.sum(axis=0)
        alphas.append(now)
    moves, opened, by_code = np.zeros((k, k)), np.zeros(k), np.zeros(e.shape)
    for t in reversed(range(len(alphas))):
        n = c.steps[t]
        at = c.codes[c.begin[:n] + t]
        gamma = alphas[t] * beta[:, :n]
        gamma /= gamma.sum(axis=0)
        for s in range(k):
            by_code[s] += np.bincount(at, weights=gamma[s], minlength=e.shape[1])
        w = e.take(at, axis=1) * beta[:, :n]
        back = a @ w
        prior = alphas[t - 1][:, :n] if t else before[:, :n]
        share = prior / (prior * back).sum(axis=0)
        if t == 0:
            opened += gamma[:, c.opening[:n]].sum(axis=1)
            share = np.where(c.opening[:n], 0.0, share)
        moves += a * (share @ w.T)
        beta[:, :n] = back / back.max(axis=0)
    return by_code, moves, opened


class Model(NamedTuple):
    """``frequent`` words, first and next states, ``emission`` of classes by state, words' ``mass`` of classes, totals."""

    frequent: pa.Array
    pi: np.ndarray
    a: np.ndarray
    emission: np.ndarray
    mass: np.ndarray
    tokens: int
    types: int


def emissions(counts: np.ndarray, mass: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Emissions by state and class (last: unknown words, with the share of one word never seen) of ``counts``."""
    unknown = 1.0 / (tokens + types + 1)
    own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    known = (1 - SHARED) * own + SHARED * mass / max(mass.sum(), 1.0)
    return np.hstack([known * (1 - unknown), np.full((len(counts), 1), unknown)])


def start(frequent, counts, mass, tokens, types, states: int) -> Model:
    """A model whose states differ at random (the same way every time) and last."""
    noise = np.exp(np.random.default_rng(0).normal(size=(states, len(counts))))
    a = np.full((states, states), (1 - LASTS) / max(states - 1, 1))
    np.fill_diagonal(a, LASTS if states > 1 else 1.0)
    emission = emissions(counts * noise / noise.sum(axis=0), mass, tokens, types)
    return Model(frequent, np.full(states, 1 / states), a, emission, mass, tokens, types)


def update(model: Model, counts: np.ndarray) -> Model:
    """The next model by the expected counts: by class, then transitions to each state, then first states."""
    k, n = len(model.pi), len(model.mass)
    moves, opened = counts[:, n : n + k] + 0.1, counts[:, n + k] + 0.1
    return model._replace(
        pi=opened / opened.sum(),
        a=moves / moves.sum(axis=1, keepdims=True),
        emission=emissions(counts[:, :n], model.mass, model.tokens, model.types),
    )


def _codes(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts) of a block."""
    codes = spread(batch.column("codes")[i].as_buffer(), "<u4")
    return codes.astype(np.int64), spread(batch.column("starts")[i].as_buffer(), np.int64)


def _flags(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.asarray(batch.column(name)[i].values.to_numpy(zero_copy_only=False))


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, k = len(m.mass), len(m.pi)
        total = np.zeros((k, n + k + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                learn = np.flatnonzero(_flags(batch, "train", i))
                if not len(learn):
                    continue
                names = spread_words(batch.column("words")[i].as_buffer())
                own = pc.fill_null(pc.index_in(names, value_set=m.frequent), -1).to_numpy(zero_copy_only=False)
                rare = spread(batch.column("rare")[i].as_buffer(), "<u2")
                of = np.where(own >= 0, own, len(m.frequent) + rare.astype(np.int64))
                codes, starts = _codes(batch, i)
                by_class, moves, opened = expected(of[codes], starts, learn, m.pi, m.a, m.emission)
                total[:, :n] += by_class[:, :n]
                total[:, n : n + k] += moves
                total[:, n + k] += opened
        there = np.flatnonzero(total.any(axis=0))
        cols = [pa.array(there, pa.int32()), *(pa.array(row[there]) for row in total)]
        yield pa.RecordBatch.from_arrays(cols, names=["class", *(f"n{i}" for i in range(k))])

    return tidy(run)


def _gathered(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Sums by class over all tasks as an array: bounded by the number of classes."""
    cols = [f"n{i}" for i in range(width)]
    sums = rows.groupBy("class").agg(*(F.sum(c).cast("double").alias(c) for c in cols)).toArrow()
    out = np.zeros((width, n))
    for i, c in enumerate(cols):
        out[i, np.asarray(sums["class"])] = np.asarray(sums[c])
    return out


def _columns(width: int) -> str:
    return ", ".join(["class int", *(f"n{i} double" for i in range(width))])


def with_class(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows with the ``class`` of their ``word``; ``frequent`` (common, own_class) has at most FREQUENT rows."""
    joined = rows.join(F.broadcast(frequent), F.col("word") == F.col("common"), "left")
    rare = frequent.count() + F.crc32(F.col("word").cast("binary")) % RARE
    return joined.withColumn("class", F.coalesce("own_class", rare).cast("int")).drop("common", "own_class")


def train(blocks: DataFrame, vocabulary: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(model, its frequent words) by Baum-Welch over all training texts of ``blocks``; only sums by class reach the driver."""
    spark = blocks.sparkSession
    learned = vocabulary.where("c > 0")
    total = learned.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = total["n"] or 0, total["v"] or 0
    # Words of at least 1 / FREQUENT of all tokens: at most FREQUENT of them, and of bounded length altogether.
    often = learned.where(F.col("c") * FREQUENT >= tokens).select("word").toArrow()
    often = often["word"].combine_chunks().cast(pa.string()).sort() if len(often) else pa.array([], pa.string())
    frequent = spark.createDataFrame(list(zip(often.to_pylist(), range(len(often)))), "common string, own_class int")
    sums = with_class(learned, frequent).select("class", F.col("c").alias("n0"), (F.col("c") + 1).alias("n1"))
    counts, mass = _gathered(sums, len(often) + RARE, 2)
    model = start(often, counts, mass, tokens, types, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        found = blocks.select("words", "rare", "codes", "starts", "train").mapInArrow(_expect(shared), _columns(states))
        model = update(model, _gathered(found, len(mass) + states + 1, states))
    return model, frequent


SCORED = (
    "doc long, nth int, whole boolean, id long, train boolean, n_tokens long, n_known long, base double, "
    "log_words double, weights array<double>, scales array<double>"
)


def _score(shared, schema: pa.Schema):
    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        m = shared.value
        batch = block.combine_chunks().to_batches()[0]
        n_words = batch.column("n_words")[0].as_py()
        codes, starts = _codes(batch, 0)
        c, at = np.zeros(n_words), np.full(n_words, len(m.mass))
        code_class = np.asarray(counts["code_class"])
        c[code_class >> 32] = np.asarray(counts["c"])
        at[code_class >> 32] = code_class & 0xFFFFFFFF
        own = np.where(c > 0, np.log((c + 1) / np.maximum(np.append(m.mass, 1)[at], 1)), 0.0)
        sums = [np.add.reduceat(np.append(w[codes], 0.0), starts[:-1]) for w in (own, np.log(c + 1), (c > 0) * 1.0)]
        sizes = np.diff(starts)
        log_words, log_counts, n_known = (np.where(sizes > 0, s, 0.0) for s in sums)
        base = (log_counts - sizes * np.log(m.tokens + m.types + 1)) / np.log(10)
        nth, last = _flags(batch, "nth", 0), _flags(batch, "last", 0)
        weights, scales = [None] * len(nth), [None] * len(nth)
        for opens in (True, False):
            pieces = np.flatnonzero((nth == 0) == opens)
            if not len(pieces):
                continue
            chunks = Chunks(at[codes], starts, pieces, np.full(len(pieces), opens))
            products, scale = chunks.products(m.a, m.emission)
            # A piece that does not open its text is carried from every state it may follow.
            ways = [chunks.forward(p, products, scale)[1:] for p in ([m.pi] if opens else np.eye(len(m.pi)))]
            for j, p in enumerate(pieces):
                weights[p] = np.concatenate([w[:, j] for w, _ in ways]).tolist()
                scales[p] = [float(s[j]) for _, s in ways]
        cols = [
            batch.column("doc")[0].values, nth, (nth == 0) & last, batch.column("id")[0].values, batch.column("train")[0].values,
            sizes, n_known.astype(np.int64), base, log_words, weights, scales,
        ]
        return pa.table([pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(cols, schema)], schema=schema)

    return run


def _join_pieces(schema: pa.Schema):
    def run(pieces: pa.Table) -> pa.Table:
        rows = sorted(pieces.to_pylist(), key=lambda r: r["nth"])
        now, scale = np.asarray(rows[0]["weights"]), rows[0]["scales"][0]
        for r in rows[1:]:
            logs = np.asarray(r["scales"])
            now = (now * np.exp(logs - logs.max())) @ np.asarray(r["weights"]).reshape(len(now), -1)
            scale += logs.max() + np.log(now.sum())
            now = now / now.sum()
        joined = rows[0] | {n: sum(r[n] for r in rows) for n in ("n_tokens", "n_known", "base", "log_words")}
        joined |= {"weights": now.tolist(), "scales": [scale], "whole": True}
        return pa.Table.from_pylist([joined], schema=schema)

    return run


def score_texts(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """A row per document: id, ``train`` (as ``learn`` says), tokens, and log10 probabilities of its text.

    ``n_tokens`` counts words and one end, ``n_known`` those seen in training, ``train_tokens`` all training tokens; ``base_score`` is the
    add-one unigram model, ``score`` the hidden Markov model. Null texts are empty and have their end; a null
    ``learn`` is false; repeated rows and ids are texts of their own; without training texts both scores are 0; an empty
    table gives none. A task holds a text's bytes and works it in pieces of 1 MB; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def arrow(ddl: str) -> pa.Schema:
        return to_arrow_schema(_parse_datatype_string(ddl))

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), text_col, F.coalesce(learn, F.lit(False)))
    blocks = materialise(rows.mapInArrow(_blocks(arrow(BLOCKS), piece_bytes), BLOCKS), "lm-blocks", **ROW_GROUPS)
    places = blocks.select("block", "words", "seen").mapInArrow(tidy(_places), "word string, place long, seen int")
    # A word has a row per block, the most frequent one too: no word has more than a small part of the rows.
    by_word = Window.partitionBy("word")
    counted = places.select(
        "word", "place", F.sum("seen").over(by_word).alias("c"),
        (F.row_number().over(by_word.orderBy("place")) == 1).alias("first"),
    )
    counted = materialise(counted, "lm-words")
    model, frequent = train(blocks, counted.where("first").select("word", "c"), states, rounds)
    code_class = F.shiftleft(F.col("place").bitwiseAND(F.lit((1 << CODE_BITS) - 1)), 32).bitwiseOR(F.col("class"))
    counts = with_class(counted.where("c > 0"), frequent).select(
        F.shiftright("place", CODE_BITS).alias("of"), code_class.alias("code_class"), "c"
    )
    narrow = blocks.drop("words", "seen", "rare")
    shared = spark.sparkContext.broadcast(model)
    scored = narrow.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_score(shared, arrow(SCORED)), SCORED)
    scored = materialise(scored, "lm-pieces")
    long = scored.where(~F.col("whole")).groupBy("doc").applyInArrow(_join_pieces(arrow(SCORED)), SCORED)
    done = scored.where("whole").unionByName(long)
    weight = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    return done.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        ((F.log(weight) + F.element_at("scales", 1) + F.col("log_words")) / F.log(F.lit(10.0))).alias("score"),
    )
