import math

import numpy as np
from pyspark.sql import functions as F

from corpusflow.functions import vectors as V
from corpusflow.operators.evaluation import (
    accuracy,
    cross_entropy,
    draw_from_probs,
    feature_covariance,
    feature_rank,
    masked_token_loss,
    metric_rollup,
)


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "v array<double>")
    out = df.select(V.top_k_mask(F.col("v"), 2).alias("m")).first().m
    assert out == [float("-inf"), 3.0, 3.0, float("-inf")]
    out = df.select(V.top_k_mask(F.col("v"), 10).alias("m")).first().m  # k capped at width
    assert out == [1.0, 3.0, 3.0, 2.0]


def test_accuracy_and_cross_entropy(spark):
    df = spark.createDataFrame([([0.0, 2.0], 1), ([3.0, 1.0], 1)], "v array<double>, label int")
    assert accuracy(df, "v", "label").first().accuracy == 0.5
    want = np.mean([math.log(1 + math.exp(-2.0)), math.log(math.exp(3) + math.exp(1)) - 1.0])
    assert abs(cross_entropy(df, "v", "label").first().loss - want) < 1e-12


def test_all_targets_ignored(spark):
    df = spark.createDataFrame([([0.0, 2.0], -1), ([3.0, 1.0], -1)], "v array<double>, t int")
    r = masked_token_loss(df, "v", "t").first()
    assert r.n_unmasked == 0 and r.loss is None


def test_draw_from_one_hot(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0, 1.0]) for i in range(20)], "k long, p array<double>")
    assert {r.draw for r in draw_from_probs(df, "p", "k", 1).collect()} == {2}


def test_rank_deficient(spark):
    rng = np.random.default_rng(0)
    rows = []
    for layer, r in [(0, 1), (1, 3), (2, 8)]:
        basis = rng.normal(size=(r, 8))
        for _ in range(200):
            rows.append((layer, (rng.normal(size=r) @ basis).tolist()))
    df = spark.createDataFrame(rows, "layer long, v array<double>")
    cov = feature_covariance(df, "v", ["layer"])
    x = np.array([v for l, v in rows if l == 1])
    got = {(r.i, r.j): r.cov for r in cov.where("layer = 1").collect()}
    ref = np.cov(x.T)
    assert max(abs(got[(i, j)] - ref[i, j]) for i in range(8) for j in range(8)) < 1e-9
    ranks = {r.layer: r.rank for r in feature_rank(cov, ["layer"]).collect()}
    assert ranks == {0: 1, 1: 3, 2: 8}


def test_metric_rollup_latest_value(spark):
    rows = [(0, "loss", 1.0, 1), (0, "loss", 0.5, 2), (0, "acc", 0.1, 1), (1, "acc", 0.9, 5)]
    df = spark.createDataFrame(rows, "at long, name string, value double, ts long")
    out = {r.at: r for r in metric_rollup(df, "at", "name", "value", "ts").collect()}
    assert out[0].loss == 0.5 and out[0].acc == 0.1 and out[1].loss is None


def test_last_position_logits(spark):
    from corpusflow.operators.evaluation import last_position

    df = spark.createDataFrame(
        [(0, 0, [9.0, 0.0], 1), (0, 1, [0.0, 9.0], 1), (1, 0, [0.0, 1.0], 0), (1, 3, [5.0, 1.0], 0)],
        "example long, pos long, logits array<double>, label long",
    )
    last = last_position(df, ["example"], "pos", ["logits", "label"])
    assert accuracy(last, "logits", "label").first().accuracy == 1.0


def test_linear_probe_sweep_flags_best(spark):
    from corpusflow.operators.evaluation import linear_probe_sweep

    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        label = i % 3
        vec = (rng.normal(size=4) + 3 * np.eye(4)[label]).tolist()
        rows.append((vec, label, "val" if i % 5 == 0 else "train"))
    df = spark.createDataFrame(rows, "v array<double>, y int, split string")
    out = linear_probe_sweep(df, "v", "y", max_iters=(2, 20)).collect()
    best = [r for r in out if r.is_best]
    assert len(best) == 1 and best[0].split == "val"
    assert best[0].accuracy == max(r.accuracy for r in out if r.split == "val")
    assert best[0].accuracy > 0.8


def test_covariance_of_large_means_and_null_groups(spark):
    rows = [(None if i < 10 else "a", [1e8 + (i % 2), 1e8 + (i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(5)
    got = {(r["g"], r["i"], r["j"]): (r["n"], r["cov"]) for r in feature_covariance(df, "v", ["g"]).collect()}
    assert len(got) == 8
    assert got[(None, 0, 1)][0] == 10 and abs(got[(None, 0, 1)][1] - 2.5 / 9) < 1e-6
    assert got[("a", 0, 1)][0] == 30 and abs(got[("a", 0, 1)][1] - 7.5 / 29) < 1e-6
