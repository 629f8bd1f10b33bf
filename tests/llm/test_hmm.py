"""Language model: counts and unigram scores by brute force, forward and Baum-Welch against plain recursions."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hmm
from corpusflow.llm.queries import op12_language_model

SF = "/root/testdata/sf0.001"


def plain_forward(codes, pi, a, e):
    now, total = pi, 0.0
    for t, c in enumerate(codes):
        now = (now if t == 0 else now @ a) * e[c]
        total += math.log(now.sum())
        now = now / now.sum()
    return total


def plain_counts(codes, pi, a, e):
    n, k = len(codes), len(pi)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for t, c in enumerate(codes):
        alpha[t] = (pi if t == 0 else alpha[t - 1] @ a) * e[c]
    for t in reversed(range(n - 1)):
        beta[t] = a @ (e[codes[t + 1]] * beta[t + 1])
    like = alpha[-1].sum()
    by_code, moves = np.zeros((len(e), k)), np.zeros((k, k))
    for t, c in enumerate(codes):
        by_code[c] += alpha[t] * beta[t] / like
        if t:
            moves += np.outer(alpha[t - 1], e[c] * beta[t]) * a / like
    return by_code, moves, alpha[0] * beta[0] / like


def test_chunks_equal_plain_recursions():
    rng = np.random.default_rng(1)
    sizes = [1, 127, 128, 129, 256, 300, 5, 1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = rng.integers(0, 7, starts[-1])
    pi, a, e = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3)
    pieces = np.arange(len(sizes))
    c = hmm.Chunks(codes, starts, pieces, np.ones(len(pieces), bool))
    m, scale = c.products(a, e)
    _, last, total = c.forward(pi, m, scale)
    parts = [codes[starts[i] : starts[i + 1]] for i in pieces]
    assert np.allclose(total + np.log(last.sum(axis=0)), [plain_forward(p, pi, a, e.T) for p in parts])
    want = [sum(x) for x in zip(*(plain_counts(p, pi, a, e.T) for p in parts))]
    for got, w in zip(hmm.expected(codes, starts, pieces, pi, a, e), want):
        assert np.allclose(got, w.T if got.shape == (3, 7) else w)


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    return [w for w in low.split(" ") if w] + [None]


def check_base(rows, scored):
    """Counts and base scores of (id, text, train) by brute force; a row of ``scored`` per text."""
    c = Counter(t for _, text, learn in rows if learn for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (i is None, i or 0, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6))
        for i, x, _ in rows
    )
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want


def test_query_by_brute_force(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    scored = op12_language_model(spark, SF).collect()
    check_base([(d.doc_id, d.text, zlib.crc32(str(d.doc_id).encode()) % 7 != 2) for d in docs], scored)
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


ODD = [(1, None, True), (2, "", True), (3, " \n ", False), (None, "A b", True), (4, "a B c", True), (4, "a B c", True), (5, "a B c new", False),
       (6, "Ünï a\tb", True), (7, "word " * 40, None), (8, "x" * 3000 + " a b", True)]


@pytest.mark.parametrize("piece", [hmm.PIECE_BYTES, 16])
def test_odd_rows_and_pieces(spark, monkeypatch, piece):
    """Cutting texts into pieces changes no count, and no score under the same model."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, learn boolean").withColumn("score", F.lit("x")).withColumn("doc", F.lit(0))
    model, real = {}, hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: model.setdefault("m", real(*a)))
    whole = hmm.score_texts(df, F.col("learn")).orderBy("doc_id", "n_tokens", "score").collect()
    check_base([(i, x, bool(t)) for i, x, t in ODD], whole)
    cut = hmm.score_texts(df, F.col("learn"), piece_bytes=piece).orderBy("doc_id", "n_tokens", "score").collect()
    assert [r[:5] for r in cut] == [r[:5] for r in whole]
    assert np.allclose([r.score for r in cut], [r.score for r in whole])


def test_ranges_of_a_long_text_cover_it():
    for text in (b"", b"a b", b"aaaa bbbb cccc dddd", b"a" * 35 + b" b", b"a" * 35, b" " * 25, b"ab " * 20):
        ranges = list(hmm.cut(np.frombuffer(text, np.uint8), 10))
        assert b"".join(text[a:b] for a, b in ranges) == text
        assert [w for a, b in ranges for w in text[a:b].split()] == text.split()


def test_no_training_and_empty_table(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, learn boolean")
    rows = hmm.score_texts(df, F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r.train_tokens == 0 and abs(r.score) < 1e-9 and r.base_score == 0 for r in rows)
    assert hmm.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_blocks_are_compressed_in_row_groups_of_their_own(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(hmm, "BLOCK_BYTES", 500)
    written, real = {}, hmm.materialise
    monkeypatch.setattr(hmm, "materialise", lambda df, name, **options: written.setdefault(name, real(df, name, **options)))
    rows = [(i, f"w{i % 7} Both words " * 20, i % 3 > 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").coalesce(2)
    check_base(rows, hmm.score_texts(df, F.col("learn")).collect())
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written["lm-blocks"].inputFiles()]
    assert sum(m.num_rows for m in files) > 3 * len(files)
    assert all(m.num_row_groups == m.num_rows for m in files)
    assert not any(kind.startswith("array<string>") for _, kind in written["lm-blocks"].dtypes)


@pytest.mark.parametrize("words", [[""], ["a", "ü", " "], [str(i) for i in range(70_000)]])
def test_blocks_squeeze_and_spread(words):
    names = pa.array(["before", *words]).slice(1)
    assert hmm.spread_words(hmm.squeezed_words(names)).to_pylist() == words
    for kind in ("<u2", "<u4", np.int64):
        values = np.arange(len(words)).astype(kind)
        assert np.array_equal(hmm.spread(hmm.squeezed(values), kind), values) and not len(hmm.spread(hmm.squeezed(values[:0]), kind))
