"""Modular-arithmetic example sets: ``[x, op, y, eq] -> label`` for prime p.

Token ids: ``eq = p`` and ``op = p + 1``. Labels of ``x+y`` and ``x-y`` are
the plain sum / difference (not reduced mod p) unless ``reduce_labels``;
``x/y`` is built backwards: inputs ``(x*y mod p, y)`` with label ``x``, y from 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported operations; division is the one that excludes y = 0.
OPERATIONS = ("x+y", "x-y", "x/y")
DIVISION_OPERATIONS = ("x/y",)


def modular_grid(spark: SparkSession, p: int, op: str, num_partitions: int | None = None) -> DataFrame:
    """All (x, y) with 0 <= x < p and 0 <= y < p (1 <= y for division).

    Generated without a join: ``x`` is a partitioned range and each row
    expands its own ``y`` sequence, so the grid is spread over tasks.
    """
    y0 = 1 if op in DIVISION_OPERATIONS else 0
    xs = spark.range(0, p, numPartitions=num_partitions).withColumnRenamed("id", "x")
    return xs.withColumn(
        "y", F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(p - 1).cast("long")))
    )


def modular_examples(
    spark: SparkSession,
    ops: Sequence[str],
    primes: Sequence[int],
    reduce_labels: bool = False,
) -> DataFrame:
    """Examples for every (operation, prime): ``op, p, x, y, inputs ARRAY<BIGINT>(4), label``."""
    frames = []
    for op in ops:
        if op not in OPERATIONS:
            raise ValueError(f"unknown operation {op!r}")
        for p in primes:
            g = modular_grid(spark, p, op)
            x, y = F.col("x"), F.col("y")
            if op == "x+y":
                a, b, label = x, y, x + y
            elif op == "x-y":
                a, b, label = x, y, x - y
            else:
                a, b, label = F.pmod(x * y, F.lit(p)), y, x
            if reduce_labels:
                label = F.pmod(label, F.lit(p))
            frames.append(
                g.select(
                    F.lit(op).alias("op"),
                    F.lit(p).cast("long").alias("p"),
                    x, y,
                    F.array(a, F.lit(p + 1).cast("long"), b, F.lit(p).cast("long")).alias("inputs"),
                    label.cast("long").alias("label"),
                )
            )
    return reduce(lambda l, r: l.unionByName(r), frames)
