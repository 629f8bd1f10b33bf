"""Exact global row index, prefix sums and thresholds without a one-task window.

A plain ``row_number() OVER (ORDER BY ...)`` or a running sum partitioned only
by (split, domain) puts a whole stream into one task. ``ordered_index`` gets
the same numbers from the order itself:

1. rows are range-partitioned and sorted by (partition columns, order columns, row
   number), the only shuffle they cross; the row number spreads equal keys, so a key held by
   a third of the rows is dealt out like any other;
2. each sorted task is written to the shared folder as it is; with a weight, a running
   sum is carried along the task's Arrow batches first;
3. a row's place in its file (``_metadata.row_index``) and the running sum are its local numbers; per
   (partition, task) a partial + final aggregate over narrow columns gives where it begins and what it holds;
4. an exclusive running sum over that small table gives the bases, which are written
   and join back: a broadcast join when their measured size allows, a shuffle join otherwise.

No window ever sees the rows. ``head_flag`` needs even less: a threshold per partition.
All joins on partition columns are null-safe: rows of a null domain form a partition of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusflow.functions.arrow import packed_ids, unpacked_ids
from corpusflow.functions.hashing import hex_prefix_int
from corpusflow.session import materialise, tasks_for

HASH_DIGITS = 5


def hash_bucket(hexcol: Column | str, digits: int = HASH_DIGITS) -> Column:
    """Bucket from the leading hex digits of an md5 order key (16**digits buckets).

    md5 keys are uniform, so 16**5 (about one million) buckets keep every
    bucket's window small up to ~10**10 rows, while the bucket-stats table
    stays at most a million rows per partition (one sort in one task).
    """
    c = F.col(hexcol) if isinstance(hexcol, str) else hexcol
    return hex_prefix_int(c, digits)


def join_same(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``cols``, null equal to null; the columns of ``left``, then the other ones of ``right``."""
    for i, c in enumerate(cols):
        right = right.withColumnRenamed(c, f"_same{i}")
    on = [left[c].eqNullSafe(right[f"_same{i}"]) for i, c in enumerate(cols)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how).drop(*[f"_same{i}" for i in range(len(cols))])


def _carry(weight: str):
    """Adds ``_before``: the sum of ``weight`` over the task's rows before each one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            w = np.asarray(batch.column(batch.schema.get_field_index(weight)), dtype=np.int64)
            before = total + np.cumsum(w) - w
            total += int(w.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "_before"]
            )

    return run


def _ids_of(df: DataFrame) -> bool:
    """Whether rows carry lists of token ids, which are shuffled and written packed."""
    return dict(df.dtypes).get("ids") == "array<int>"


def range_buckets(
    df: DataFrame,
    part_cols: Sequence[str],
    order_cols: Sequence[str],
    weight: str | None = None,
    n_tokens: int | None = None,
) -> DataFrame:
    """``df`` in order, written to the shared folder, with ``_bkt``: its range partition by (part_cols, order_cols).

    Rows with equal keys are told apart by a row number, so they spread over partitions too. With
    ``weight`` (a long column without nulls) also ``_before``, its sum over the partition's earlier rows. ``n_tokens``: how many ids the rows carry, if they do.
    """
    n = tasks_for(df.sparkSession, n_tokens)
    keys = [*part_cols, *order_cols, "_uid"]
    rows = df.withColumn("_uid", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_uid")
    if weight is not None:
        rows = rows.mapInArrow(_carry(weight), StructType([*rows.schema.fields, StructField("_before", LongType())]))
    return materialise(rows.withColumn("_bkt", F.spark_partition_id().cast("long")), "range-buckets")


def ordered_index(
    df: DataFrame,
    order_cols: Sequence[str],
    part_cols: Sequence[str] = (),
    bucket: Column | None = None,
    weight: str | Column | None = None,
    idx_col: str = "_idx",
    count_col: str = "_n",
    start_col: str = "_start",
    total_col: str = "_total",
) -> DataFrame:
    """Add the 0-based rank of every row within ``part_cols`` by ``order_cols``, nulls first.

    Also adds the partition row count. With ``weight``: the exclusive running
    sum of the weight (``start_col``; null weighs 0) and the partition total (``total_col``).
    ``bucket``, if given, is non-decreasing in ``order_cols`` and compared before them.
    """
    part_cols, order_cols = list(part_cols), list(order_cols)
    ids = _ids_of(df) and "ids" not in [*part_cols, *order_cols]
    if bucket is not None:
        df, order_cols = df.withColumn("_first_key", bucket), ["_first_key", *order_cols]
    if weight is not None:
        w = F.col(weight) if isinstance(weight, str) else weight
        df = df.withColumn("_w", F.coalesce(w.cast("long"), F.lit(0)))
    if ids:
        n_tokens = df.agg(F.sum("n_tokens")).first()[0] if "n_tokens" in df.columns else None
        df = df.withColumn("ids", F.when(F.col("ids").isNotNull(), packed_ids("ids")))
    rows = range_buckets(df, part_cols, order_cols, "_w" if weight is not None else None, n_tokens if ids else None)
    rows = rows.select("*", F.col("_metadata.row_index").alias("_at"), F.col("_metadata.file_name").alias("_file"))
    runs = ["_bkt", "_file"]
    aggs = [F.count(F.lit(1)).alias("_bn"), F.min("_at").alias("_at0")]
    if weight is not None:
        aggs += [F.sum("_w").alias("_bw"), F.min("_before").alias("_before0")]
    stats = rows.groupBy(*part_cols, *runs).agg(*aggs)
    whole = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(*runs).rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        *part_cols,
        *runs,
        (F.coalesce(F.sum("_bn").over(earlier), F.lit(0)) - F.col("_at0")).alias("_rows0"),
        F.sum("_bn").over(whole).alias(count_col),
    ]
    if weight is not None:
        cols += [
            (F.coalesce(F.sum("_bw").over(earlier), F.lit(0)) - F.col("_before0")).alias("_sum0"),
            F.sum("_bw").over(whole).cast("long").alias(total_col),
        ]
    bases = materialise(stats.select(*cols), "bucket-bases")
    out = join_same(rows, bases, [*part_cols, *runs])
    out = out.withColumn(idx_col, (F.col("_at") + F.col("_rows0")).cast("long"))
    drop = ["_bkt", "_file", "_at", "_rows0", "_first_key"]
    if weight is not None:
        out = out.withColumn(start_col, (F.col("_before") + F.col("_sum0")).cast("long"))
        drop += ["_w", "_before", "_sum0"]
    if ids:
        back = unpacked_ids(F.coalesce("ids", F.lit(b"\x01")))
        out = out.withColumn("ids", F.when(F.col("ids").isNotNull(), back))
    return out.drop(*drop)


TIED = "rows with equal order keys lie on both sides of the cut: the keys must be unique"


def _threshold(df: DataFrame, order_cols: Sequence[str], part_cols: Sequence[str], bucket: Column, head_size) -> DataFrame:
    """A written row per partition: ``_thr``, the order key of its last head row, and ``_take`` of the ``_tied`` rows that have it.

    Bucket counts locate the bucket of that row; only its rows are counted by key (so a key that repeats is a row)
    and summed up in order. Partitions with an empty head have no row.
    """
    keyed = df.select(*part_cols, *order_cols, bucket.alias("_bkt"))
    whole = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    stats = keyed.groupBy(*part_cols, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    stats = stats.select(
        *part_cols, "_bkt", "_bn", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_rows0"),
        head_size(F.sum("_bn").over(whole)).cast("long").alias("_k"),
    )
    pivot = stats.where((F.col("_rows0") < F.col("_k")) & (F.col("_rows0") + F.col("_bn") >= F.col("_k")))
    pivot = materialise(pivot.select(*part_cols, "_bkt", (F.col("_k") - F.col("_rows0")).alias("_need")), "pivots")
    near = join_same(keyed, pivot, [*part_cols, "_bkt"])
    near = near.groupBy(*part_cols, *order_cols).agg(F.count(F.lit(1)).alias("_tied"), F.first("_need").alias("_need"))
    upto = F.sum("_tied").over(whole.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_upto", upto)
    at = near.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_tied") < F.col("_need")))
    take = F.col("_need") - F.col("_upto") + F.col("_tied")
    return materialise(at.select(*part_cols, order_key(order_cols).alias("_thr"), take.alias("_take"), "_tied"), "thresholds")


COARSE_DIGITS = 2  # of each key in the joint counts: 65,536 cells a partition at most


def nested_thresholds(
    df: DataFrame,
    first: Sequence[str],
    second: Sequence[str],
    part_cols: Sequence[str],
    first_size,
    second_size,
) -> DataFrame | None:
    """Both cuts of a nested split from one count of the rows: ``_thr1`` and ``_thr2`` per partition, written.

    ``first`` and ``second`` are order columns led by an md5 key. The first ``first_size(n)`` rows by ``first`` are cut
    off; of the others the first ``second_size(n)`` by ``second``. Joint counts by both coarse buckets locate the bucket
    of the first cut and, as the rows of that bucket are on either side, the few buckets that the second can lie in.
    Only rows of those buckets are written and looked at again. An empty head has a null threshold. None if
    rows with equal keys lie on both sides of a cut.
    """
    part_cols = list(part_cols)
    keyed = df.select(*part_cols, *dict.fromkeys([*first, *second])).withColumns(
        {"_b1": hash_bucket(first[0], COARSE_DIGITS), "_b2": hash_bucket(second[0], COARSE_DIGITS)}
    )
    cells = materialise(keyed.groupBy(*part_cols, "_b1", "_b2").agg(F.count(F.lit(1)).alias("_c")), "joint-counts")
    whole = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy(F.lit(0))
    earlier = Window.unboundedPreceding, -1

    rows1 = cells.groupBy(*part_cols, "_b1").agg(F.sum("_c").alias("_c1"))
    rows1 = rows1.select(
        *part_cols, "_b1", "_c1", F.coalesce(F.sum("_c1").over(whole.orderBy("_b1").rowsBetween(*earlier)), F.lit(0)).alias("_rows0"),
        first_size(F.sum("_c1").over(whole)).cast("long").alias("_k1"), second_size(F.sum("_c1").over(whole)).cast("long").alias("_k2"),
    )
    cut = (F.col("_rows0") < F.col("_k1")) & (F.col("_rows0") + F.col("_c1") >= F.col("_k1"))
    found = lambda value: F.max(F.when(cut, value))
    pivot = rows1.groupBy(*part_cols).agg(
        F.coalesce(found(F.col("_b1")), F.lit(-1)).alias("_p1"),
        F.coalesce(found(F.col("_k1") - F.col("_rows0")), F.lit(0)).alias("_need1"),
        F.coalesce(found(F.col("_c1")), F.lit(0)).alias("_maybe"),
        F.first("_k2").alias("_k2"),
    )
    pivot = materialise(pivot, "first-pivots")

    # rows behind the first cut for sure, and rows of its bucket, by the bucket of the second key
    by2 = attach(cells, pivot, part_cols).groupBy(*part_cols, "_b2", "_need1", "_maybe", "_k2").agg(
        F.sum(F.when(F.col("_b1") > F.col("_p1"), F.col("_c")).otherwise(0)).alias("_sure"),
        F.sum(F.when(F.col("_b1") == F.col("_p1"), F.col("_c")).otherwise(0)).alias("_open"),
    )
    order = whole.orderBy("_b2")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(*earlier)), F.lit(0))
    by2 = by2.withColumns({"_sure0": before("_sure"), "_open0": before("_open")})
    least = F.col("_sure0") + F.greatest(F.lit(0), F.col("_open0") - F.col("_need1"))
    open1 = F.col("_open0") + F.col("_open")
    most = F.col("_sure0") + F.col("_sure") + F.least(open1, F.col("_maybe") - F.col("_need1"))
    can = by2.where((least < F.col("_k2")) & (most >= F.col("_k2")))
    can = can.groupBy(*part_cols).agg(F.min("_b2").alias("_lo"), F.max("_b2").alias("_hi"), F.min("_sure0").alias("_sure0"))
    table = materialise(attach(pivot, can, part_cols), "cut-ranges")

    near = attach(keyed, table, part_cols)
    within = F.coalesce(F.col("_b2").between(F.col("_lo"), F.col("_hi")), F.lit(False))
    at1 = F.col("_b1") == F.col("_p1")
    near = materialise(near.where(at1 | ((F.col("_b1") > F.col("_p1")) & within)), "near-cuts")

    thr1 = _threshold(near.where(at1), first, [*part_cols, "_need1"], hash_bucket(first[0]), lambda n: F.col("_need1"))
    thr1 = thr1.withColumnRenamed("_thr", "_thr1").drop("_need1")
    rest = attach(near, thr1, part_cols).where(~at1 | F.coalesce(order_key(first) > F.col("_thr1"), F.lit(True)))
    passed = rest.where(at1 & (F.col("_b2") < F.col("_lo"))).groupBy(*part_cols).agg(F.count(F.lit(1)).alias("_passed"))
    need2 = F.col("_k2") - F.col("_sure0") - F.coalesce("_passed", F.lit(0))
    rest = attach(rest.where(within), materialise(passed, "passed"), part_cols).withColumn("_need2", need2)
    thr2 = _threshold(rest, second, [*part_cols, "_need2"], hash_bucket(second[0]), lambda n: F.col("_need2"))
    thr2 = thr2.withColumnRenamed("_thr", "_thr2").drop("_need2")
    if not thr1.where("_take < _tied").isEmpty() or not thr2.where("_take < _tied").isEmpty():
        return None
    parts = attach(pivot.select(*part_cols), thr1.drop("_take", "_tied"), part_cols)
    return materialise(attach(parts, thr2.drop("_take", "_tied"), part_cols), "nested-thresholds")


def order_key(order_cols: Sequence[str]) -> Column:
    """The order columns as one value that compares like them."""
    return F.struct(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(order_cols)])


def head_flag(
    df: DataFrame,
    order_cols: Sequence[str],
    part_cols: Sequence[str],
    bucket: Column,
    head_size,
    flag_col: str = "_head",
    break_ties: bool = False,
) -> DataFrame:
    """Flag the first ``head_size(n)`` rows of every partition by ``order_cols``, shuffling no rows.

    Only the *threshold* -- the order key of the k-th row -- is needed, not every row's rank, and every row
    compares its key with its partition's threshold (a row per partition, whose join the planner chooses).
    Where rows with equal keys lie on both sides of the cut an error is raised, or with
    ``break_ties`` the rows are written and the first of them in their files are taken, so the size is exact.
    """
    part_cols, order_cols = list(part_cols), list(order_cols)
    thr = _threshold(df, order_cols, part_cols, bucket, head_size)
    key, below = order_key(order_cols), F.lit(False)
    if not thr.where("_take < _tied").isEmpty():
        if not break_ties:
            raise ValueError(TIED)
        columns = df.columns
        df = materialise(df, "tied-rows").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))
        cut = attach(df, thr.where("_take < _tied").drop("_tied"), part_cols).where(key == F.col("_thr"))
        cut = ordered_index(cut.select(*part_cols, "_place", "_take"), ["_place"], part_cols).where("_idx = _take - 1")
        last = materialise(cut.select(*part_cols, F.col("_place").alias("_last")), "tied-cuts")
        df = attach(df, last, part_cols)
        below = F.col("_last").isNotNull() & (key == F.col("_thr")) & (F.col("_place") > F.col("_last"))
    else:
        columns = df.columns
    flagged = attach(df, thr.drop("_take", "_tied"), part_cols)
    flag = F.coalesce(key <= F.col("_thr"), F.lit(False)) & ~below
    return flagged.select(*columns, flag.alias(flag_col))


def _literal(value, kind) -> Column:
    if value is not None and isinstance(kind, StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def attach(df: DataFrame, table: DataFrame, part_cols: Sequence[str]) -> DataFrame:
    """Rows with the other columns of ``table``, which has at most a row per partition (nulls where it has none).

    Without partition columns these are literals, so there is no join.
    """
    if part_cols:
        return join_same(df, table, part_cols, "left")
    row = table.first()
    return df.withColumns({f.name: _literal(row and row[f.name], f.dataType) for f in table.schema.fields})
