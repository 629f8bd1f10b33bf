"""Rows numbered 0 .. n-1 for every row of a small table, generated by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16


def count_up(df: DataFrame, n: Column, out_col: str, chunk: int = CHUNK) -> DataFrame:
    """Each row of ``df`` once for every number below ``n``, in ``out_col``; none where n is 0, negative or null.

    Chunks of numbers are dealt out over all tasks before they become rows, so that one large ``n``
    is not one task's work and no array of numbers is longer than n / chunk or chunk.
    """
    size = F.lit(chunk).cast("long")
    chunks = df.withColumn("_n", n.cast("long")).where(F.col("_n") > 0)
    chunks = chunks.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size).cast("long")))
    )
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(n_tasks, "_chunk", "_n")
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * size) - 1
    return chunks.withColumn(out_col, F.explode(F.sequence(F.col("_chunk") * size, last))).drop("_n", "_chunk")
