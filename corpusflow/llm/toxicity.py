"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts their common subsequences of ``ORDER`` letters, each weighted by a decay
to the power of the span it takes in either word, gaps and inserted characters included. Landmarks are
words of labelled texts; similarities to them, whitened by their own kernel matrix, are the features
of a linear squared-hinge SVM. A text is as toxic as its worst sentence, a sentence as its worst word
(a multiple-instance SVM: a toxic text names the word that speaks most for its label, and that choice
and the machine are fitted in turn).

The machine is linear in the subsequence counts of a word, so for scoring it is one weight for each
sequence of ``ORDER`` letters, and every distinct word of a batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.sample import least_hashed, one_row_an_id
from corpusflow.llm.textbytes import flat, slices, words
from corpusflow.session import materialise

ORDER = 4
SPAN = 7  # letters of a subsequence lie within so many characters
DECAY = 0.6
LETTERS = 32  # a to z, five classes of other letters, and 0 for what is no letter
POSITIVE_ROWS, NEGATIVE_ROWS = 1500, 3000  # labelled texts that are fitted, at most
MAX_FIT_CHARS = 50_000  # labelled texts longer than this are not fitted (all are scored)
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS = 160, 64
HARD_NEGATIVES = 3000
ROUNDS = 4
RIDGE = 0.05

SHAPES = [(0, *c) for s in range(ORDER - 1, SPAN) for c in combinations(range(1, s + 1), ORDER - 1) if c[-1] == s]


@dataclass(frozen=True)
class ToxicityModel:
    """A weight per sequence of ``ORDER`` letters (4 MB), the offset, and a logistic map to 0..1."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


@cache
def _codes() -> np.ndarray:
    """Letter class of every code point (of lower-cased text)."""
    out = np.fromiter((27 + c % 5 if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word, words per text). Runs of single characters make one word."""
    data, offsets = flat(texts)
    starts, ends, _ = words(data, offsets)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single = points[ends] - points[starts] == 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (text[1:] == text[:-1])
    first = ~joined
    starts, ends, text = starts[first], ends[np.append(first[1:], True)], text[first]
    bounds = np.empty(2 * len(starts), dtype=np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    both = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers).dictionary_encode()
    used, index = np.unique(np.asarray(both.indices)[0::2], return_inverse=True)
    return both.dictionary.take(pa.array(used)), index, np.bincount(text, minlength=len(offsets) - 1)


def subsequences(vocabulary: pa.Array) -> tuple[Iterator[tuple[np.ndarray, np.ndarray, float]], int]:
    """For each shape of gaps: (word, sequence code, weight) of every subsequence of letters."""
    lower = pc.utf8_lower(vocabulary)
    data, offsets = flat(lower)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = _codes()[points]
    word = np.repeat(np.arange(len(vocabulary)), np.diff(at))
    end = np.repeat(at[1:], np.diff(at))

    def shapes():
        position = np.arange(len(codes))
        for shape in SHAPES:
            i = position[: max(0, len(codes) - shape[-1])]
            i = i[(i + shape[-1] < end[: len(i)]) & (codes[: len(i)] > 0)]
            for gap in shape[1:]:
                i = i[codes[i + gap] > 0]
            key = codes[i]
            for gap in shape[1:]:
                key = key * np.uint32(LETTERS) + codes[i + gap]
            yield word[i], key.astype(np.int64), DECAY ** (shape[-1] + 1)

    return shapes(), len(vocabulary)


def margins(vocabulary: pa.Array, weights: np.ndarray, offset: float) -> np.ndarray:
    """The machine's value of every word, with the length of its subsequence vector taken out."""
    shapes, n = subsequences(vocabulary)
    total, square = np.zeros(n), np.zeros(n)
    for word, key, weight in shapes:
        total += np.bincount(word, weights=weights[key], minlength=n) * weight
        square += np.bincount(word, minlength=n) * weight**2
    return total / np.sqrt(np.maximum(square, 1e-12)) + offset


def _kernel(vocabulary: pa.Array, columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words and landmarks. ``columns`` maps a sequence code to a row of ``landmarks``, or -1."""
    out = np.zeros((len(vocabulary), landmarks.shape[1]))
    for a in range(0, len(vocabulary), 1000):
        shapes, n = subsequences(vocabulary.slice(a, 1000))
        table, square = np.zeros(n * len(landmarks)), np.zeros(n)
        for word, key, weight in shapes:
            square += np.bincount(word, minlength=n) * weight**2
            known = columns[key] >= 0
            np.add.at(table, word[known] * len(landmarks) + columns[key[known]], weight)
        out[a : a + n] = table.reshape(n, -1) @ landmarks / np.sqrt(np.maximum(square, 1e-12))[:, None]
    return out


def _landmark_matrix(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each row, columns, unit subsequence vectors of the landmarks as columns)."""
    shapes, n = subsequences(vocabulary)
    parts = [(w, k, np.full(len(w), x)) for w, k, x in shapes]
    word, key, weight = (np.concatenate(x) for x in zip(*parts))
    codes, row = np.unique(key, return_inverse=True)
    table = np.zeros((len(codes), n))
    np.add.at(table, (row, word), weight)
    table /= np.maximum(np.linalg.norm(table, axis=0, keepdims=True), 1e-12)
    columns = np.full(LETTERS**ORDER, -1, dtype=np.int64)
    columns[codes] = np.arange(len(codes))
    return codes, columns, table


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last for a constant) of least squared hinge loss and ridge, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), dtype=bool)
    for _ in range(30):
        xa, wa = x[active], weight[active][:, None]
        w = np.linalg.solve(ridge + xa.T @ (xa * wa), xa.T @ (y[active] * weight[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that map margins to probabilities."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w, target = np.array([2.0, 0.0]), np.where(y > 0, (y > 0).sum() + 1, 1) / np.where(y > 0, (y > 0).sum() + 2, (y <= 0).sum() + 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


def train(vocabulary: pa.Array, bags: list[np.ndarray], labels: np.ndarray) -> ToxicityModel:
    """Fit on ``bags`` of word indexes (the distinct words of each text) and their 0/1 ``labels``."""
    none = ToxicityModel(np.zeros(LETTERS**ORDER, np.float32), 0.0, 1.0, -5.0)
    toxic = np.flatnonzero(labels == 1)
    clean = np.flatnonzero(labels != 1)
    if not len(toxic) or not len(clean):
        return none
    # What speaks for toxicity at first: four letters in a row that toxic texts have more often.
    shapes, n = subsequences(vocabulary)
    word, key, _ = next(shapes)
    order = np.argsort(word, kind="stable")
    word, key = word[order], key[order]
    at = np.searchsorted(word, np.arange(n + 1))
    seen = np.zeros((2, LETTERS**ORDER))
    for bag, label in zip(bags, labels):
        if len(bag):
            np.add.at(seen[label], np.unique(np.concatenate([key[at[w] : at[w + 1]] for w in bag])), 1)
    odds = np.log((seen[1] + 0.5) / (len(toxic) + 1)) - np.log((seen[0] + 0.5) / (len(clean) + 1))
    odds[seen[1] < 2] = 0
    value = np.zeros(n)
    np.maximum.at(value, word, odds[key])

    negatives = np.unique(np.concatenate([bags[i] for i in clean]))
    if not len(negatives):
        return none
    common = np.bincount(np.concatenate([bags[i] for i in clean]), minlength=n)
    weights, offset = None, 0.0
    for _ in range(ROUNDS):
        witnesses = np.array([bags[i][np.argmax(value[bags[i]])] for i in toxic if len(bags[i])])
        if not len(witnesses):
            return none
        hard = negatives[np.argsort(-value[negatives], kind="stable")[:HARD_NEGATIVES]]
        frequent = negatives[np.argsort(-common[negatives], kind="stable")[:HARD_NEGATIVES]]
        if weights is None:
            names, n_of = np.unique(witnesses, return_counts=True)
            best = names[np.lexsort((-value[names], -n_of))][:POSITIVE_LANDMARKS]
            lower = np.concatenate([hard[: NEGATIVE_LANDMARKS // 2], frequent[: NEGATIVE_LANDMARKS // 2]])
            chosen = np.unique(np.concatenate([best, lower]))
            codes, columns, marks = _landmark_matrix(vocabulary.take(pa.array(chosen)))
            values, vectors = np.linalg.eigh(marks.T @ marks)
            good = values > 1e-6 * values.max()
            whiten = vectors[:, good] / np.sqrt(values[good])
        others = np.unique(np.concatenate([hard, frequent]))
        rows = np.concatenate([witnesses, others])
        y = np.concatenate([np.ones(len(witnesses)), -np.ones(len(others))])
        balance = np.where(y > 0, len(others) / len(witnesses), 1.0)
        unique, place = np.unique(rows, return_inverse=True)
        z = (_kernel(vocabulary.take(pa.array(unique)), columns, marks) @ whiten)[place]
        w = _svm(z, y, balance)
        weights = np.zeros(LETTERS**ORDER, dtype=np.float32)
        weights[codes] = marks @ (whiten @ w[:-1])
        offset = float(w[-1])
        value = margins(vocabulary, weights, offset)
    margin = np.array([value[b].max() if len(b) else offset for b in bags])
    slope, shift = _logistic(margin, np.where(labels == 1, 1, -1))
    return ToxicityModel(weights, offset, slope, shift)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positive_rows: int = POSITIVE_ROWS,
    negative_rows: int = NEGATIVE_ROWS,
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled texts: per label, those of least md5 of the id among ``usable``.

    Only ids and labels are ranked; the chosen texts become lists of distinct words in the tasks. Rows
    with a null id or label, or another label than 0 and 1, are not used.
    """
    known = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    rows = F.when(F.col("y") == 1, positive_rows).otherwise(negative_rows)
    chosen = least_hashed(known, "y", rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = materialise(chosen, "toxicity-ids")
    # positive_rows + negative_rows rows, one per id; rows that equal them give way in the tasks and after them.
    rows = one_row_an_id(texts.join(F.broadcast(chosen), "id"), "id", "text", "y")
    rows = materialise(rows, "toxicity-sample")
    sample = texts.withColumn("digest", F.xxhash64("text")).join(F.broadcast(rows), ["id", "digest"])
    sample = sample.where(F.length("text") <= MAX_FIT_CHARS).select("id", "y", "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            batch = batch.take(pa.array([i for i, x in enumerate(ids) if not (x in seen or seen.add(x))], pa.int64()))
            for a, b in slices(batch.column(2)):
                vocabulary, index, per_text = distinct_words(batch.column(2).slice(a, b - a))
                bags = [np.unique(x) for x in np.split(index, np.cumsum(per_text)[:-1])]
                lists = [vocabulary.take(pa.array(x, pa.int64())).to_pylist() for x in bags]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lists, pa.list_(pa.string()))],
                    names=["id", "y", "words"],
                )

    kind = sample.schema["id"].dataType.simpleString()
    lists = sample.mapInArrow(listed, f"id {kind}, y int, words array<string>").dropDuplicates(["id"])
    table = lists.toArrow().sort_by("id")
    lists = table["words"].combine_chunks()
    flat_words = lists.flatten().cast(pa.large_string()).dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
    index = np.asarray(flat_words.indices)
    bags = [index[a:b] for a, b in zip(bounds, bounds[1:])]
    return train(flat_words.dictionary, bags, np.asarray(table["y"]))


def score_texts(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """A probability for every text; a text without words gets that of the offset alone."""
    out = [np.zeros(0)]
    for a, b in slices(texts):
        vocabulary, index, per_text = distinct_words(texts.slice(a, b - a))
        best = np.full(b - a, model.offset)
        if len(index):
            value = margins(vocabulary, model.weights, model.offset)[index]
            some = per_text > 0
            best[some] = np.maximum.reduceat(value, (np.cumsum(per_text) - per_text)[some])
        out.append(model.probability(best))
    return np.concatenate(out)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score``, ``predicted``) of every document, by its whole text alone.

    Null and empty texts get a low score; repeated rows are scored alike; null ids pass through; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(batch.column(1), model)
            arrays = [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
