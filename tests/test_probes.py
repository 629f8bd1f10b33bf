"""Probes against a plain numpy fit, covariance tiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators.evaluation import feature_covariance, feature_rank
from corpusflow.operators.probes import covariance_of_tiles, covariance_tiles, fit_probes


def plain_fit(x, y, train, n_classes, steps):
    """(accuracies by step, best step, its weights) of accelerated gradient descent on the mean train loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (0.5 * (x[train] ** 2).sum() / train.sum())
    looked = last = np.zeros((n_classes, x.shape[1]))
    accs, best = [], (-1, None, None)
    for step in range(steps + 1):
        z = x @ looked.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        hit = z.argmax(axis=1) == y
        accs.append((hit[train].mean(), hit[~train].mean()))
        if accs[-1][1] > best[0]:
            best = (accs[-1][1], step, looked)
        grad = (p - np.eye(n_classes)[y])[train].T @ x[train] / train.sum()
        new = looked - rate * grad
        looked, last = new + step / (step + 3) * (new - (last if step else new)), new
    return accs, best[1], best[2]


def test_probes_equal_a_numpy_fit(spark):
    rng = np.random.default_rng(5)
    rows, plain = [], {}
    for layer in (0, None, 2):
        y = rng.integers(0, 3, 200)
        x = rng.normal(size=(200, 6)) + 1.5 * np.eye(6)[y] * ((layer or 0) + 0.3)
        train = rng.random(200) < 0.8
        rows += [(layer, x[i].tolist(), int(y[i]), "train" if train[i] else "val") for i in range(200)]
        plain[(layer,)] = plain_fit(x, y, train, 3, 6)
    rows += [(0, None, 1, "train"), (0, [0.0] * 6, None, "train")]
    df = spark.createDataFrame(rows, "layer long, v array<double>, y int, split string").repartition(5)
    got = fit_probes(df, "v", "y", ["layer"], steps=6)
    table = {(r.layer, r.step, r.split): r for r in got.accuracies.collect()}
    assert len(table) == 3 * 7 * 2
    for key, (accs, best, weights) in plain.items():
        assert np.abs(got.weights[key] - weights).max() < 1e-6
        for step, (a, b) in enumerate(accs):
            assert abs(table[(*key, step, "train")].accuracy - a) < 1e-9 and abs(table[(*key, step, "val")].accuracy - b) < 1e-9
        assert [s for s in range(7) if table[(*key, s, "val")].is_best] == [best]
        assert not any(table[(*key, s, "train")].is_best for s in range(7))


@pytest.mark.parametrize("d, n", [(8, 50), (300, 40)])
def test_tiles_equal_numpy(spark, d, n):
    x = np.random.default_rng(d).normal(size=(n, d)) + 100
    df = spark.createDataFrame([(None, row.tolist()) for row in x], "g string, v array<double>").repartition(3)
    cov = feature_covariance(df, "v", ["g"]).collect()
    got = np.full((d, d), np.nan)
    for r in cov:
        got[r.i, r.j] = r["cov"]
    assert len(cov) == d * d and np.abs(got - np.cov(x.T)).max() < 1e-9


def test_wide_vectors_are_few_rows(spark):
    """Per group six rows of tiles at width 768, and the rank by their matrix."""
    basis = np.random.default_rng(1).normal(size=(3, 768))
    rows = [(i % 2, (np.random.default_rng(i).normal(size=3) @ basis).tolist()) for i in range(60)]
    tiles = covariance_tiles(spark.createDataFrame(rows, "layer long, v array<double>"), "v", ["layer"])
    assert tiles.count() == 2 * 6
    assert {r.layer: r["rank"] for r in feature_rank(tiles, ["layer"]).collect()} == {0: 3, 1: 3}


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "g string, v array<double>")
    assert [r["cov"] for r in feature_covariance(df, "v", ["g"]).collect()] == [None] * 4
    assert covariance_of_tiles(covariance_tiles(df.where(F.lit(False)), "v", ["g"]), ["g"]).count() == 0
    assert fit_probes(df.where(F.lit(False)).selectExpr("g", "v", "1 y", "'train' split"), "v", "y", ["g"], steps=1).weights == {}
