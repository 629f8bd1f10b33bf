"""Hard negatives by R-tree against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import rtree


def test_tree_holds_every_row_and_bounds_its_products():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-200, 200, (1500, 6))
    vectors[:400] = vectors[0]
    ids = rng.permutation(1500)
    order, tree = rtree.str_pack(vectors, ids)
    assert sorted(order) == list(range(1500))
    leaves = [(a, b) for a, b, c, d in zip(tree.first, tree.stop, tree.child, tree.child_stop) if c == d]
    assert sorted(x for a, b in leaves for x in range(a, b)) == list(range(1500))
    for anchor in vectors[::300]:
        low, high = rtree.bounds(tree.low, tree.high, anchor)
        for i, (a, b) in enumerate(zip(tree.first, tree.stop)):
            scores = vectors[order][a:b] @ anchor
            assert low[i] <= scores.min() and scores.max() <= high[i]


def by_brute_force(rows, scale=256):
    """Sorted result of (vec_id, embedding, label, anchor) rows."""
    fit = []
    for uid, (i, x, label, anchor) in enumerate(rows):
        if i is None or label is None or not x or any(c is None or not np.isfinite(c) for c in x):
            continue
        fit.append((uid, i, [int(np.floor(scale * float(c))) for c in x], label, anchor))
    out = []
    for uid, i, q, label, anchor in fit:
        if not anchor:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, lab == label) for u, j, p, lab, _ in fit if u != uid and len(p) == len(q)]
        for ps, pid in sorted((s, j) for s, j, same in scored if same)[:5]:
            ps = -ps
            hits = sorted((s, j) for s, j, same in scored if not same and 50 * ps <= -100 * s <= 95 * ps)[:3]
            out += [(i, pid, r + 1, j, ps, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, anchor boolean").repartition(parts)
    df = df.withColumn("score", F.lit(1)).withColumn("uid", F.lit(0)).withColumn("kind", F.lit("x"))
    got = rtree.mine(df, F.col("anchor"))
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("leaf", [4, 32])
def test_mined_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(rtree, "LEAF", leaf)
    rng = random.Random(leaf)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(1200):
        c = centres[i % 6]
        rows.append((i, [x + rng.gauss(0, 0.6) for x in c], rng.choice([i % 6, i % 3, 9]), i % 20 == 0))
    assert mined(spark, rows) == by_brute_force(rows)


def test_a_third_equal_ties_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(k, [0.5, 0.25, -0.5], k % 4, k % 50 == 0) for k in range(400)]
    rows += [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)], rng.randint(0, 3), k % 50 == 0) for k in range(400, 900)]
    rows += [(50, [0.5, 0.25, -0.5], 2, True)] * 3  # repeated anchors
    rows += [(None, [0.5, 0.5, 0.5], 1, True), (1000, None, 1, True), (1050, [0.5, 0.5, 0.5], None, True), (1100, [], 1, True)]
    rows += [(1150, [0.5, None, 0.5], 1, True), (1200, [0.5, float("nan"), 0.5], 1, True), (1250, [float("inf"), 0.1, 0.5], 1, True)]
    rows += [(2000 + k, [0.1 * k, 0.5], k % 3, k % 2 == 0) for k in range(12)]  # another length
    rows += [(3000, [1.0, 0.0, 0.0], 77, True), (3001, [9.0, 9.0, 9.0], 1, None)]  # no positive; null flag
    assert mined(spark, rows) == by_brute_force(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1e6, 1e6) for _ in range(4)], k % 3, k % 10 == 0) for k in range(200)]
    assert mined(spark, rows) == by_brute_force(rows)
    with pytest.raises(ValueError, match="long"):
        mined(spark, [(1, [1e9, 1.0], 0, True), (2, [1e9, 1.0], 0, True)])


def test_empty_table_and_no_anchor(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rtree.mine(df, F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert rtree.mine(df, F.lit(False)).collect() == []
