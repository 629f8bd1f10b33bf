"""Linear probes of all layers in shared passes, and covariance as packed tiles.

Both sum small matrices over the rows of every group. A task adds up its own rows in numpy and emits a packed binary
row per group (and tile); these meet in two rounds of grouping, first by a salt, so neither the rows nor the
partial sums of a group ever stand in one task at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SALTS, TILE = 8, 256


def _schema(df: DataFrame, group_cols: Sequence[str], more: str) -> StructType:
    """The group columns of ``df`` and the columns of ``more``."""
    own = [df.schema[c] for c in group_cols]
    return StructType([*own, *_parse_datatype_string(more).fields])


def _grouped(batch: pa.RecordBatch, n_keys: int) -> dict:
    """{group values: row numbers} of a batch whose first columns are the group's."""
    keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)))) or [()] * batch.num_rows
    at: dict = {}
    for row, key in enumerate(keys):
        at.setdefault(key, []).append(row)
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _rows(rows: list, schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


# -- covariance -------------------------------------------------------------------------------------------------

TILES = "ti int, tj int, dim int, salt int, n long, mean_i binary, mean_j binary, m2 binary"


def _merge_moments(a, b):
    """(n, means of rows and columns, co-moments) of two disjoint sets of rows, around their common mean."""
    (n, x, y, m), (k, u, v, w) = a, b
    total = n + k
    return total, x + (u - x) * (k / total), y + (v - y) * (k / total), m + w + np.outer(u - x, v - y) * (n * k / total)


def covariance_tiles(reps: DataFrame, vec_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Co-moments of the vectors of every group: a row per tile (``ti`` <= ``tj``) of TILE x TILE coordinates.

    ``n`` rows, means and centred co-moments as packed doubles; a task emits a row per group and tile, whatever the
    rows or the width. Null group values are a group, null vectors are left out.
    """
    group_cols = list(group_cols)
    schema = _schema(reps, group_cols, TILES)
    arrow = to_arrow_schema(schema)
    k = len(group_cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(k))
                for key, rows in _grouped(batch, k).items():
                    own = x[rows]
                    mean = own.mean(axis=0)
                    part = (len(own), mean, mean, (own - mean).T @ (own - mean))
                    acc[key] = _merge_moments(acc[key], part) if key in acc else part
        salt = TaskContext.get().partitionId() % SALTS
        for key, (n, mean, _, m2) in acc.items():
            rows, d = [], len(mean)
            for i in range(0, d, TILE):
                for j in range(i, d, TILE):
                    a, b = slice(i, i + TILE), slice(j, j + TILE)
                    rows.append((*key, i // TILE, j // TILE, d, salt, n, mean[a].tobytes(), mean[b].tobytes(), m2[a, b].tobytes()))
            yield from _rows(rows, arrow).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        whole = None
        for r in table.to_pylist():
            x, y = np.frombuffer(r["mean_i"]), np.frombuffer(r["mean_j"])
            part = (r["n"], x, y, np.frombuffer(r["m2"]).reshape(len(x), len(y)))
            whole = part if whole is None else _merge_moments(whole, part)
        n, x, y, m = whole
        return _rows([tuple((r | {"n": n, "mean_i": x.tobytes(), "mean_j": y.tobytes(), "m2": m.tobytes()})[f.name] for f in arrow)], arrow)

    inp = reps.select(*group_cols, vec_col).where(F.col(vec_col).isNotNull())
    parts = inp.mapInArrow(partial, schema)
    by = [*group_cols, "ti", "tj", "dim"]
    parts = parts.groupBy(*by, "salt").applyInArrow(merge, schema)
    return parts.groupBy(*by).applyInArrow(merge, schema).drop("salt")


def covariance_of_tiles(tiles: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """(group..., i, j, n, cov) for every pair of coordinates; null where a group has one row."""
    schema = _schema(tiles, group_cols, "i int, j int, n long, cov double")
    names, k = [f.name for f in schema.fields], len(group_cols)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(c).type for c in names[:k]]
            for r in batch.to_pylist():
                rows, cols = len(r["mean_i"]) // 8, len(r["mean_j"]) // 8
                i, j = np.divmod(np.arange(rows * cols), cols)
                i, j = i + r["ti"] * TILE, j + r["tj"] * TILE
                cov = np.frombuffer(r["m2"]) / max(r["n"] - 1, 1)
                for mirrored in ((False, True) if r["ti"] != r["tj"] else (False,)):
                    a, b = (j, i) if mirrored else (i, j)
                    keys = [pa.array([r[c]] * len(cov), t) for c, t in zip(names[:k], types)]
                    own = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.full(len(cov), r["n"], np.int64))]
                    value = pa.array(cov) if r["n"] > 1 else pa.nulls(len(cov), pa.float64())
                    yield pa.RecordBatch.from_arrays([*keys, *own, value], names=names)

    return tiles.mapInArrow(expand, schema)


def rank_of_tiles(tiles: DataFrame, group_cols: Sequence[str], eps: float) -> DataFrame:
    """Numerical rank of each group's covariance: singular values above ``sigma_max * d * eps``.

    A group's tiles are one d x d matrix, bounded by the width of the vectors.
    """
    schema = _schema(tiles, group_cols, "rank long, sigma_max double")
    arrow = to_arrow_schema(schema)

    def rank(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        d = rows[0]["dim"]
        m = np.zeros((d, d))
        for r in rows:
            i, j = r["ti"] * TILE, r["tj"] * TILE
            h, w = len(r["mean_i"]) // 8, len(r["mean_j"]) // 8
            tile = np.frombuffer(r["m2"]).reshape(h, w) / max(r["n"] - 1, 1)
            m[i : i + h, j : j + w] = tile
            m[j : j + w, i : i + h] = tile.T
        s = np.linalg.svd(m, compute_uv=False)
        top = float(s.max(initial=0.0))
        return _rows([(*(rows[0][c] for c in group_cols), int((s > top * d * eps).sum()), top)], arrow)

    return tiles.groupBy(*group_cols).applyInArrow(rank, schema)


# -- linear probes ------------------------------------------------------------------------------------------------

SUMS = "salt int, n_train long, n_val long, hit_train long, hit_val long, square double, loss double, grad binary"


@dataclass
class Probes:
    """``accuracies`` (group..., step, split, n, accuracy, is_best) and, per group, the ``weights`` (classes x (d + 1)) of its best step."""

    accuracies: DataFrame
    weights: dict


def _add(a, b):
    return [x + y for x, y in zip(a, b)]


def _pass(data: DataFrame, group_cols, vec_col, label_col, split_col, weights, n_classes: int) -> dict:
    """{group: (n, hits, sum of squares, loss, gradient)} of all groups under ``weights`` (None: zero) in one pass."""
    schema = _schema(data, group_cols, SUMS)
    arrow, k = to_arrow_schema(schema), len(group_cols)
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(k))
            labels = np.asarray(batch.column(k + 1).to_numpy(zero_copy_only=False), dtype=np.int64)
            train = np.asarray(batch.column(k + 2).to_pylist()) == "train"
            for key, rows in _grouped(batch, k).items():
                own = np.hstack([x[rows], np.ones((len(rows), 1))])
                y, t = labels[rows], train[rows]
                w = shared.value.get(key) if shared.value else None
                w = np.zeros((n_classes, own.shape[1])) if w is None else w
                z = own @ w.T
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                hit = p.argmax(axis=1) == y
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))[t].sum()
                p[np.arange(len(y)), y] -= 1
                sums = [int(t.sum()), int((~t).sum()), int(hit[t].sum()), int(hit[~t].sum()), float((own[t] ** 2).sum()), float(loss), p[t].T @ own[t]]
                acc[key] = _add(acc[key], sums) if key in acc else sums
        salt = TaskContext.get().partitionId() % SALTS
        yield from _rows([(*key, salt, *s[:-1], s[-1].tobytes()) for key, s in acc.items()], arrow).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = [f.name for f in arrow][k + 1 : -1]
        total = {n: sum(r[n] for r in rows) for n in names}
        total["grad"] = sum(np.frombuffer(r["grad"]) for r in rows).tobytes()
        return _rows([tuple((rows[0] | total)[f.name] for f in arrow)], arrow)

    rows = data.select(*group_cols, vec_col, label_col, split_col).mapInArrow(partial, schema)
    out: dict = {}
    for r in rows.groupBy(*group_cols, "salt").applyInArrow(merge, schema).collect():  # SALTS rows a layer at most
        sums = [r[n] for n in ("n_train", "n_val", "hit_train", "hit_val", "square", "loss")]
        key = tuple(r[c] for c in group_cols)
        sums.append(np.frombuffer(r["grad"]).reshape(n_classes, -1))
        out[key] = _add(out[key], sums) if key in out else sums
    return out


def fit_probes(
    reps: DataFrame, vec_col: str, label_col: str, group_cols: Sequence[str] = (), split_col: str = "split", steps: int = 15
) -> Probes:
    """Soft-max regression of ``label_col`` (0 ..) on the vectors of every group, all groups in each pass.

    Accelerated gradient descent on the mean train loss from zero weights: every step is one pass that sums losses and
    gradients of all groups, and counts the hits of the weights it was given. The step with the best
    validation accuracy (the earliest of equals) is kept, as a probe keeps its best. Rows without vector, label or
    split are left out; rows of a split other than ``train`` are validation.
    """
    spark, group_cols = reps.sparkSession, list(group_cols)
    there = F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & F.col(split_col).isNotNull()
    data = reps.where(there).withColumn(label_col, F.col(label_col).cast("long"))
    top = data.agg(F.max(label_col).alias("top")).first()["top"]
    n_classes = 0 if top is None else int(top) + 1
    looked, last, best, history = {}, {}, {}, []
    for step in range(steps + 1):
        sums = _pass(data, group_cols, vec_col, label_col, split_col, looked, n_classes)
        for key, (n, n_val, hit, hit_val, square, loss, grad) in sums.items():
            w = looked.get(key, np.zeros_like(grad))
            for split, count, hits in (("train", n, hit), ("val", n_val, hit_val)):
                if count:
                    history.append((*key, step, split, count, hits / count))
            if n_val and (key not in best or hit_val > best[key][0]):
                best[key] = (hit_val, step, w)
            # the loss of a row curves at most half its squared length
            new = w - grad / max(n, 1) / max(0.5 * square / max(n, 1), 1e-12)
            looked[key] = new + (step / (step + 3)) * (new - last.get(key, new))
            last[key] = new
    schema = _schema(reps, group_cols, "step int, split string, n long, accuracy double, is_best boolean")
    k = len(group_cols)
    rows = [(*h, h[k + 1] == "val" and h[k] == best[h[:k]][1]) for h in history]
    return Probes(spark.createDataFrame(rows, schema), {key: b[2] for key, b in best.items()})
