"""Repetition coverage: characters inside duplicated n-grams and lines.

Word ids are exact within a batch; n-grams of every length come from one polynomial prefix hash
(modulo 2**64) over mixed word ids. A duplicated (n+1)-gram lies where n-grams are duplicated, so each
length looks only at what the one before has left. The verdict counts characters inside repetitions, the
first occurrence left out, each character once per length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.textbytes import flat, slices, span_ids, words

#: Share of word characters that duplicated n-grams may cover, by n, and that duplicated lines may.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS = 50
BASE_N = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    ", ".join(f"{c} long" for c in COUNTS)
    + ", dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
    + ", base_failed boolean, kept boolean"
)

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a public finaliser: xor-shifts and odd multipliers)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hash of any window of a sequence of values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))
        n = len(values)
        power = np.full(n + 1, _ROOT, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        self.back = np.full(n + 1, inverse, dtype=np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(values + 1) * power[:-1], dtype=np.uint64)])

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        return _mix((self.sums[at + n] - self.sums[at]) * self.back[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(keys), dtype=bool)
    out[order] = twice
    return out


def after_first(keys: np.ndarray) -> np.ndarray:
    """Which of the keys have an equal one before them."""
    later = np.ones(len(keys), dtype=bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return later


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text; null texts count as empty."""
    data, offsets = flat(texts)
    starts, ends, n_words = words(data, offsets)
    docs = np.repeat(np.arange(len(n_words)), n_words)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    per_text = lambda per_word: np.bincount(docs, weights=per_word, minlength=len(n_words)).astype(np.int64)
    chars = points[ends] - points[starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": n_words, "word_chars": per_text(chars), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_docs = np.searchsorted(offsets, line_starts, side="right") - 1
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_ends = np.minimum(next_break, offsets[line_docs + 1])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_docs = line_starts[worded], line_ends[worded], line_docs[worded]
    ids = span_ids(data, line_starts, line_ends)
    key = line_docs * (ids.max(initial=0) + 1) + ids
    later = after_first(key)
    count = lambda rows, weights=None: np.bincount(rows, weights=weights, minlength=len(n_words)).astype(np.int64)
    out["n_dup_lines"] = count(line_docs[later])
    in_words = np.concatenate([[0], np.cumsum(chars)])
    of_line = in_words[np.searchsorted(starts, line_ends)] - in_words[np.searchsorted(starts, line_starts)]
    out["dup_line_chars"] = count(line_docs[later], of_line[later])

    hashes = RollingHash(span_ids(data, starts, ends))
    salt = _mix(docs + 1)
    at = np.arange(max(0, len(docs) - BASE_N + 1))
    for n in (BASE_N, *NGRAM_LIMITS):
        at = at[at + n <= len(docs)]
        at = at[docs[at] == docs[at + n - 1]]
        keys = hashes.windows(at, n) ^ salt[at]
        twice = repeated(keys)
        at, keys = at[twice], keys[twice]
        counted = at if n == BASE_N else at[after_first(keys)]
        inside = np.bincount(counted, minlength=len(docs) + 1) - np.bincount(counted + n, minlength=len(docs) + 1)
        covered = np.cumsum(inside)[:-1] > 0
        if n == BASE_N:
            out["n_repeat_words"] = per_text(covered)
        else:
            out[f"dup_{n}gram_chars"] = per_text(covered * chars)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    total = np.maximum(m["word_chars"], 1)
    bad = m["dup_line_chars"] > LINE_LIMIT * total
    for n, limit in NGRAM_LIMITS.items():
        bad |= m[f"dup_{n}gram_chars"] > limit * total
    return base, ~base & ~bad


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, the counts of its whole text, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike; null
    ids pass through; other columns are ignored. A text is held whole in a task, several at a time
    only up to a few MB.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                m = measure(texts.slice(a, b - a))
                base, kept = verdict(m)
                names = [*COUNTS, "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)]
                arrays = [ids.slice(a, b - a), *(pa.array(m[c], pa.int64()) for c in names), pa.array(base), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *names, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, {SCHEMA}")
