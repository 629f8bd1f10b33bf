"""Evaluation over scored tables: accuracy, losses, sampling from scores,
representation covariance and rank, linear probes, metric roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import vectors as V
from corpusflow.functions.hashing import hash_uniform
from corpusflow.operators.probes import covariance_of_tiles, covariance_tiles, rank_of_tiles


def last_position(df: DataFrame, example_cols: Sequence[str], pos_col: str, cols: Sequence[str]):
    """Keep each example's row at its last position (``max_by``, partial aggregation)."""
    return df.groupBy(*example_cols).agg(
        *[F.max_by(c, pos_col).alias(c) for c in cols]
    )


def accuracy(scores: DataFrame, logits_col: str, label_col: str, group_cols: Sequence[str] = ()):
    """Share of rows whose arg-max equals the label."""
    hit = (V.argmax(F.col(logits_col)) == F.col(label_col).cast("long")).cast("double")
    return scores.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")
    )


def cross_entropy(scores: DataFrame, logits_col: str, label_col: str, group_cols: Sequence[str] = ()):
    """Mean negative log-softmax at the label (a size-weighted mean over batches)."""
    nll = V.nll_at(V.as_double(F.col(logits_col)), F.col(label_col))
    return scores.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg(nll).alias("loss"))


def masked_token_loss(
    scores: DataFrame, logits_col: str, target_col: str, group_cols: Sequence[str] = (),
    ignore_index: int = -1,
):
    """Per-token loss (0 where the target is ignored), mean over the unmasked tokens only.

    The index lookup sits inside the guard, so ANSI mode never sees index -1.
    """
    keep = F.col(target_col) != F.lit(ignore_index)
    nll = F.when(keep, V.nll_at(V.as_double(F.col(logits_col)), F.col(target_col))).otherwise(0.0)
    return scores.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(keep.cast("long")).alias("n_unmasked"),
        F.try_divide(F.sum(nll), F.sum(keep.cast("double"))).alias("loss"),
    )


def softmax_temperature(df: DataFrame, vec_col: str, temperature: float, out_col: str = "probs"):
    return df.withColumn(out_col, V.softmax(V.as_double(F.col(vec_col)), temperature))


def draw_from_probs(df: DataFrame, probs_col: str, key_col: str, seed, out_col: str = "draw"):
    """One categorical draw per row, reproducible from (seed, key)."""
    return df.withColumn(out_col, V.draw_index(F.col(probs_col), hash_uniform(seed, key_col)))


def top_k_mask(df: DataFrame, vec_col: str, k: int, out_col: str | None = None):
    return df.withColumn(out_col or vec_col, V.top_k_mask(F.col(vec_col), k))


def feature_covariance(reps: DataFrame, vec_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Unbiased d x d covariance of the vectors of every group (null group values are a group), a row per pair (i, j).

    Tasks emit packed tiles of centred co-moments (:func:`corpusflow.operators.probes.covariance_tiles`), merged
    pairwise, so large means do not cancel; only the result is a row per pair.
    """
    return covariance_of_tiles(covariance_tiles(reps, vec_col, group_cols), list(group_cols))


def feature_rank(cov: DataFrame, group_cols: Sequence[str], eps: float = float(np.finfo(np.float32).eps)):
    """Numerical rank of each group's covariance (SVD of the d x d matrix), from tiles or from rows per pair.

    The tolerance is sigma_max * d * eps(float32), the usual default for float32
    representations. A group is a d x d matrix, so the per-group task
    is bounded by the vector width, not by the data.
    """
    group_cols = list(group_cols)
    if "m2" in cov.columns:
        return rank_of_tiles(cov, group_cols, eps)
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in cov.schema.fields if f.name in group_cols]
        + ["rank long", "sigma_max double"]
    )

    def rank_of(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        m = np.zeros((d, d))
        m[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["cov"].to_numpy()
        s = np.linalg.svd(m, compute_uv=False)
        tol = s.max(initial=0.0) * d * eps
        row = {c: [pdf[c].iloc[0]] for c in group_cols}
        row.update(rank=[int((s > tol).sum())], sigma_max=[float(s.max(initial=0.0))])
        return pd.DataFrame(row)

    return cov.select(*group_cols, "i", "j", "cov").groupBy(*group_cols).applyInPandas(rank_of, schema)


def mean_rank(ranks: DataFrame, keep_cols: Sequence[str]) -> DataFrame:
    """Mean rank over batches (every batch counts, not only the last)."""
    return ranks.groupBy(*keep_cols).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_batches"))


def linear_probe(
    reps: DataFrame,
    vec_col: str,
    label_col: str,
    split_col: str = "split",
    max_iter: int = 100,
    reg: float = 0.0,
) -> tuple[object, DataFrame]:
    """Fit a multinomial logistic regression on train rows; accuracy on train and val rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = reps.withColumn("features", array_to_vector(V.as_double(F.col(vec_col)))).withColumn(
        "label", F.col(label_col).cast("double")
    )
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg)
    model = lr.fit(data.where(F.col(split_col) == "train"))
    pred = model.transform(data)
    acc = pred.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
    )
    return model, acc


def linear_probe_sweep(
    reps: DataFrame,
    vec_col: str,
    label_col: str,
    split_col: str = "split",
    max_iters: Sequence[int] = (10, 25, 50, 100),
    reg: float = 0.0,
) -> DataFrame:
    """Probe accuracies for several training budgets; the best validation one is flagged.

    The probe keeps its best validation accuracy over training; Spark's fit
    exposes only its final model, so each budget is one distributed fit and
    ``is_best`` marks the validation row with the highest accuracy (the
    smallest budget on ties).
    """
    frames = []
    for it in max_iters:
        _, acc = linear_probe(reps, vec_col, label_col, split_col, max_iter=it, reg=reg)
        frames.append(acc.withColumn("max_iter", F.lit(int(it))))
    accs = reduce(lambda a, b: a.unionByName(b), frames)
    val = F.col(split_col) == "val"
    w = Window.partitionBy(split_col).orderBy(F.desc("accuracy"), F.asc("max_iter"))
    return accs.withColumn("is_best", val & (F.row_number().over(w) == 1))


def metric_rollup(
    log: DataFrame,
    axis_col: str,
    name_col: str,
    value_col: str,
    ts_col: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Wide table per axis point: latest value (by ``ts_col``) of every metric name.

    Without ``names`` Spark looks them up first. Give ``ts_col`` a column that orders all rows of a
    name (a struct of time and id) where times repeat.
    """
    g = log.groupBy(axis_col)
    pivoted = g.pivot(name_col, list(names)) if names is not None else g.pivot(name_col)
    return pivoted.agg(F.max_by(value_col, ts_col))
