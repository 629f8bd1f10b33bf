"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialise


def least_hashed(rows: DataFrame, label: str, limit: Column) -> DataFrame:
    """Of (id, ``label``) the ``limit`` rows of each label with the least md5 of the id; limit is a column over label.

    Only rows whose hash is small enough for the limit and eight standard deviations more are ranked, so
    that what meets in a task does not grow with the table and hardly exceeds the limit.
    """
    h = F.md5(F.col("id").cast("string"))
    part = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    # Written first: Spark then knows it for a small table, and filters the rows before it shuffles them.
    sizes = materialise(rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")), "label-sizes")
    near = rows.join(sizes, F.col(label) == F.col("_label")).where(part * F.col("_n") <= limit + 8 * F.sqrt(limit) + 32)
    nth = F.row_number().over(Window.partitionBy(label).orderBy("_h", "id"))
    ranked = near.withColumn("_h", h).withColumn("_nth", nth)
    return ranked.where(F.col("_nth") <= limit).select("id", label)


def one_row_an_id(rows: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, digest, ``more``) of one row per id, that of the least digest of its text and ``more``; no null ids.

    Combined before the shuffle, so an id that repeats costs each task a row.
    """
    row = F.struct(F.xxhash64(text_col).alias("digest"), *more)
    least = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(row).alias("row"))
    return least.select("id", "row.*")
