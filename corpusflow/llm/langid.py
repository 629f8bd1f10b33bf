"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter trigrams (word ends count as a letter). Each
language has several centroids from spherical k-means over a bounded sample of labelled texts. A text
gets the language of the centroid of highest cosine and is rejected if it is far from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.columns import passing
from corpusflow.llm.sample import least_hashed, one_row_an_id
from corpusflow.llm.textbytes import flat, pieces, slices, tidy
from corpusflow.session import materialise

FEATURES = 4096
SAMPLE_PER_LANG = 1000  # labelled texts that are fitted for each language, at most
CENTROIDS_PER_LANG = 4
ROUNDS = 10
#: A text is rejected if its best cosine is below this part of what all but 1 % of the sample reach.
REJECT_PART = 0.5
#: Texts of fewer letters reach less: their limit falls with the root of the number of letters.
FULL_LETTERS = 100
UNKNOWN = "und"
SLICE_BYTES = 1_000_000
SLICE_ROWS = 512  # texts counted at a time: a row of FEATURES counts each


@dataclass(frozen=True)
class LanguageModel:
    """What the tasks need: a few centroids per language, at most a few MB for hundreds of languages."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]  # of each centroid
    reject_below: float


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, place) of every trigram around a letter; places count the characters of all texts."""
    data, offsets = flat(pc.utf8_lower(texts))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = _letters()[points]
    at = np.flatnonzero(letter)
    text = np.searchsorted(before, at, side="right") - 1
    codes = np.where(letter, points, 0).astype(np.uint64)
    padded = np.concatenate([[np.uint64(0)], codes, [np.uint64(0)]])
    left, right = padded[at].copy(), padded[at + 2].copy()
    left[np.isin(at, before[:-1])] = 0
    right[np.isin(at + 1, before[1:])] = 0
    key = (left * np.uint64(1_000_003) + codes[at]) * np.uint64(1_000_003) + right
    key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)
    return text, key.astype(np.int64), at


def _long_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``counts`` of one text, a part of it at a time; what stands around a part is seen but not counted."""
    table, letters = np.zeros((1, FEATURES), dtype=np.int64), 0
    for part, before, after in pieces(text, SLICE_BYTES):
        _, key, at = trigrams(pa.array([part]))
        own = key[(at >= before) & (at < len(part) - after)]
        table[0] += np.bincount(own, minlength=FEATURES)
        letters += len(own)
    return table, np.array([letters])


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts x features) counts, and letters per text."""
    if len(texts) == 1 and len(text := texts[0].as_py() or "") > SLICE_BYTES:
        return _long_counts(text)
    text, key, _ = trigrams(texts)
    letters = np.bincount(text, minlength=len(texts))
    table = np.bincount(text * FEATURES + key, minlength=len(texts) * FEATURES)
    return table.reshape(len(texts), FEATURES), letters


def vectors(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows; a row without features is zero."""
    x = np.log1p(table.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart rows; fewer centroids if clusters stay empty."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centroids = x[chosen]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = [x[nearest == c].sum(axis=0) for c in range(len(centroids)) if (nearest == c).any()]
        centroids = np.array(sums)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def fit(
    docs: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = SAMPLE_PER_LANG,
    centroids_per_lang: int = CENTROIDS_PER_LANG,
) -> LanguageModel:
    """Fit on at most ``per_lang`` rows of each language, those of least md5 of the id among ``usable`` ones.

    Of an id that repeats, one row counts. Only ids and labels are ranked; the chosen texts become trigram
    counts in the tasks, and only those reach the driver.
    Rows without label, id or letters are not used. Without any usable row every text is unknown.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = materialise(one_row_an_id(known, "id", "text", "lang"), "lang-rows")
    chosen = least_hashed(rows.select("id", "lang"), "lang", F.lit(per_lang)).join(rows, ["id", "lang"])
    # per_lang rows of each language, one per id; rows that equal them give way in the tasks and after them.
    chosen = materialise(chosen.select("id", "lang", "digest"), "lang-sample")
    sample = known.withColumn("digest", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "lang", "digest"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            batch = batch.take(pa.array([i for i, x in enumerate(ids) if not (x in seen or seen.add(x))], pa.int64()))
            ids, langs, texts = batch.columns
            for a, b in slices(texts, SLICE_BYTES, SLICE_ROWS):
                table, letters = counts(texts.slice(a, b - a).fill_null(""))
                rows = [i for i in range(b - a) if letters[i]]
                out = [(langs[a + i].as_py(), np.flatnonzero(table[i])) for i in rows]
                names = ids.take(pa.array([a + i for i in rows], pa.int64()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": names,
                        "lang": pa.array([lang for lang, _ in out], pa.string()),
                        "keys": pa.array([k for _, k in out], pa.list_(pa.int32())),
                        "tfs": pa.array([table[i][k] for i, (_, k) in zip(rows, out)], pa.list_(pa.int32())),
                    }
                )

    kind = known.schema["id"].dataType.simpleString()
    found = sample.select("id", "lang", "text").mapInArrow(features, f"id {kind}, lang string, keys array<int>, tfs array<int>")
    found = found.dropDuplicates(["id"]).toArrow()
    if not found.num_rows:
        return LanguageModel(np.zeros(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), (), 0.0)
    keys, tfs = found["keys"].combine_chunks(), found["tfs"].combine_chunks()
    rows = np.repeat(np.arange(found.num_rows), np.diff(np.asarray(keys.offsets)))
    table = np.zeros((found.num_rows, FEATURES), dtype=np.float32)
    table[rows, np.asarray(keys.values)] = np.asarray(tfs.values)
    labels = np.array(found["lang"].to_pylist(), dtype=object)
    # Rows come in any order; a fixed one keeps the fitted model the same.
    order = np.lexsort((table @ np.arange(1, FEATURES + 1, dtype=np.float32), labels.astype(str)))
    table, labels = table[order], labels[order]
    idf = (np.log((1 + len(table)) / (1 + (table > 0).sum(axis=0))) + 1).astype(np.float32)
    x = vectors(table, idf)
    parts, langs, best = [], [], np.zeros(len(x))
    for lang in sorted(set(labels)):
        own = labels == lang
        centroids = _clusters(x[own], centroids_per_lang)
        best[own] = (x[own] @ centroids.T).max(axis=1)
        parts.append(centroids)
        langs += [lang] * len(centroids)
    limit = REJECT_PART * float(np.quantile(best, 0.01))
    return LanguageModel(idf, np.concatenate(parts).astype(np.float32), tuple(langs), limit)


def predict(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, best cosine, rejected) of every text; texts without a letter are unknown and rejected."""
    langs, scores, rejected = [], [], []
    for a, b in slices(texts, SLICE_BYTES, SLICE_ROWS):
        table, letters = counts(texts.slice(a, b - a).fill_null(""))
        some = (letters > 0) & (len(model.langs) > 0)
        sims = vectors(table, model.idf) @ model.centroids.T if len(model.langs) else np.zeros((b - a, 1))
        nearest, score = sims.argmax(axis=1), np.where(some, np.clip(sims.max(axis=1), 0, 1), 0.0)
        langs += [model.langs[c] if ok else UNKNOWN for c, ok in zip(nearest, some)]
        scores.append(score)
        limit = model.reject_below * np.sqrt(np.minimum(1, letters / FULL_LETTERS))
        rejected.append(~some | (score < limit))
    return langs, np.concatenate(scores or [np.zeros(0)]).astype(float), np.concatenate(rejected or [np.zeros(0, bool)])


def classify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``rejected``) of every row: language of the nearest centroid and its cosine.

    Null texts and texts without a letter get ``und`` with score 0. Repeated rows are scored alike, null
    ids pass through, other columns are ignored. Whole texts count, a few hundred of them or a part of a long one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = predict(batch.column(1), model)
            arrays = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~predict(batch.column(at), model)[2]))

    return passing(docs, (text_col,), lambda d: d.mapInArrow(tidy(run), d.schema))
