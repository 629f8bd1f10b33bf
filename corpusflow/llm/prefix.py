"""Distributed prefix sums over a range-sorted table.

The rows are range-partitioned and sorted, each task adds up its own rows, and the totals of the
tasks (one row per task and group) are summed in task order. No window ever sees the rows of a whole
group, so a group that holds most rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusflow.session import materialise


def range_prefix(
    df: DataFrame, group: str, order: Sequence[Column], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    """``df`` with ``_row`` and ``_before``: rows, and sum of ``value``, before each row in its group.

    ``df`` has to be narrow and cheap to read twice (range partitioning samples it); ``value`` is a
    non-negative long without nulls. ``order`` decides within a group; rows that it leaves equal get
    distinct places in any order. Null groups count as one group, sorted last.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_last(), *order, F.col("_uid").asc()]
    rows = df.withColumn("_uid", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("_task", "_row", "_before"))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, count, total = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(batch.schema.get_field_index(group))
            codes = np.asarray(col.dictionary_encode(null_encoding="encode").indices)
            values = np.asarray(batch.column(batch.schema.get_field_index(value)), dtype=np.int64)
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            before, row = np.cumsum(values) - values, np.arange(len(values))
            sizes = np.diff(np.append(starts, len(values)))
            row = row - np.repeat(starts, sizes)
            before = before - np.repeat(before[starts], sizes)
            if col[0].as_py() == last:
                row[: sizes[0]] += count
                before[: sizes[0]] += total
            last = col[-1].as_py()
            count, total = int(row[-1]) + 1, int(before[-1]) + int(values[-1])
            more = [np.full(len(values), task), row, before]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.int64()) for x in more)],
                names=[*batch.schema.names, "_task", "_row", "_before"],
            )

    local = materialise(rows.mapInArrow(add_up, schema), name)
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = local.groupBy("_task", group).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    bases = materialise(
        tasks.select(
            F.col("_task").alias("_t"),
            F.col(group).alias("_g"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows0"),
            F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_sum0"),
        ),
        f"{name}-bases",
    )
    out = local.join(bases, (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumns(
        {"_row": F.col("_row") + F.col("_rows0"), "_before": F.col("_before") + F.col("_sum0")}
    ).drop("_uid", "_task", "_t", "_g", "_rows0", "_sum0")
