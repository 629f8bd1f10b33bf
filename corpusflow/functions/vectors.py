"""Array expressions over score vectors (logits, probabilities), all native.

A per-row scalar (max, normaliser, threshold) must be computed once per row,
not once per element: an outer expression referenced inside a lambda body is
re-evaluated for every element, which is quadratic in the vector width (a
50k-entry vocabulary). Scalars therefore enter lambdas either through the
initial state of ``aggregate`` or through ``zip_with`` against
``array_repeat(scalar, n)``, both evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def argmax(v: Column) -> Column:
    """0-based index of the largest value (first one on ties)."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda a, b: a + b)


def with_scalar(v: Column, scalar: Column, fn) -> Column:
    """``transform(v, x -> fn(x, scalar))`` with ``scalar`` evaluated once per row."""
    return F.zip_with(v, F.array_repeat(scalar, F.size(v)), fn)


def log_sum_exp(v: Column) -> Column:
    """Max-shifted log-sum-exp of a double array, one pass after the max."""
    init = F.struct(F.array_max(v).alias("m"), F.lit(0.0).cast("double").alias("s"))
    return F.aggregate(
        v,
        init,
        lambda st, x: F.struct(st["m"].alias("m"), (st["s"] + F.exp(x - st["m"])).alias("s")),
        lambda st: st["m"] + F.log(st["s"]),
    )


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Soft-max of ``v / temperature`` (max-shifted)."""
    t = F.lit(float(temperature))
    e = with_scalar(v, F.array_max(v), lambda x, m: F.exp((x - m) / t))
    return with_scalar(e, array_sum(e), lambda x, s: x / s)


def nll_at(v: Column, label: Column) -> Column:
    """Negative log-softmax of ``v`` at 0-based ``label``."""
    return log_sum_exp(v) - F.element_at(v, (label + 1).cast("int"))


def top_k_threshold(v: Column, k: int) -> Column:
    return F.element_at(F.sort_array(v, asc=False), F.least(F.lit(k), F.size(v)))


def top_k_mask(v: Column, k: int) -> Column:
    """Keep values >= the k-th largest (ties at the border stay), others -inf."""
    return with_scalar(
        v, top_k_threshold(v, k), lambda x, thr: F.when(x >= thr, x).otherwise(F.lit(float("-inf")))
    )


def draw_index(p: Column, u: Column) -> Column:
    """First index whose running sum exceeds ``u * sum(p)`` (last index if rounding misses)."""
    init = F.struct(
        (u * array_sum(p)).alias("t"),
        F.lit(0.0).cast("double").alias("acc"),
        F.lit(-1).cast("long").alias("pick"),
        F.lit(0).cast("long").alias("i"),
    )

    def step(s, x):
        acc = s["acc"] + x
        pick = F.when((s["pick"] < 0) & (acc > s["t"]), s["i"]).otherwise(s["pick"])
        return F.struct(s["t"].alias("t"), acc.alias("acc"), pick.alias("pick"), (s["i"] + 1).alias("i"))

    return F.aggregate(p, init, step, lambda s: F.when(s["pick"] < 0, s["i"] - 1).otherwise(s["pick"]))
