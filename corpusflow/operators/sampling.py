"""Training windows, weighted domain draws and epoch batches.

Draws are md5 functions of (seed, stream, draw number): reproducible under
retries and any partitioning. Window contents are gathered from the block
table with an equi-join on ``block_id`` (a window of S+1 tokens touches at
most ceil((S+1)/L)+1 blocks), never by materialising one row per token. Given a
block store, a batch takes lengths from its index and opens only the files that its windows touch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.hashing import hash_index, hash_uniform, seeded_key
from corpusflow.operators.mixing import STREAM, _gather, stream_lengths
from corpusflow.plans.generate import count_up
from corpusflow.plans.index import hash_bucket, head_flag, ordered_index
from corpusflow.session import materialise
from corpusflow.sources.blockstore import BlockStore


def n_windows(stream_len, seq_len: int):
    """Number of non-overlapping window starts 0, S, 2S, ... < len - S."""
    S = F.lit(seq_len)
    return F.when(stream_len > S, F.ceil((stream_len - S) / S)).otherwise(F.lit(0)).cast("long")


def window_starts(totals: DataFrame, seq_len: int, len_col: str = "stream_len") -> DataFrame:
    """All window starts of every stream (one row per window, not per token)."""
    counted = count_up(totals, n_windows(F.col(len_col), seq_len), "start")
    return counted.withColumn("start", F.col("start") * F.lit(seq_len))


def _windows_from_draws(blocks, draws, block_len, seq_len, src_cols, keep_cols):
    """draws: (src_cols..., keep_cols..., ``start``) -> keep_cols, start, x, y (length S)."""
    spans = draws.withColumn("length", F.lit(seq_len + 1).cast("long")).withColumn(
        "out_offset", F.lit(0).cast("long")
    )
    out_cols = [*keep_cols, *[c for c in src_cols if c not in keep_cols], "start"]
    # Written first: the planner sees the size of a batch of draws and, while it is small, broadcasts it
    # and reads the blocks in place.
    spans = materialise(spans, "window-draws")
    got = _gather(blocks, spans, block_len, src_cols, out_cols, out_block_len=seq_len + 1)
    return got.select(
        *out_cols,
        F.slice("ids", 1, seq_len).alias("x"),
        F.slice("ids", 2, seq_len).alias("y"),
    )


def sample_windows(
    blocks: DataFrame | BlockStore,
    block_len: int,
    seq_len: int,
    batch_size: int,
    seed,
    src_cols: Sequence[str] = STREAM,
) -> DataFrame:
    """``batch_size`` windows per stream, uniformly with replacement; ``y`` is ``x`` shifted by one."""
    lens = stream_lengths(blocks, src_cols).withColumn("_nw", n_windows(F.col("stream_len"), seq_len))
    draws = lens.where(F.col("_nw") > 0).withColumn(
        "sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batch_size - 1).cast("long")))
    )
    draws = draws.withColumn(
        "start", hash_index(seed, F.col("_nw"), *src_cols, "sample_id") * F.lit(seq_len)
    ).select(*src_cols, "sample_id", "start")
    return _windows_from_draws(blocks, draws, block_len, seq_len, src_cols, ["sample_id"])


def domain_weight_table(lens: DataFrame, weights: dict[str, float] | None, seq_len: int) -> DataFrame:
    """Domains with at least one window, cumulative weights as half-open [lo, hi) ranges.

    One row per domain: small by construction (the domain registry). The last range ends at 1.
    """
    lens = lens.withColumn("_nw", n_windows(F.col("stream_len"), seq_len)).where(F.col("_nw") > 0)
    if weights is None:
        table = lens.withColumn("weight", F.lit(1.0))
        order = F.col("domain")
    else:
        spark = lens.sparkSession
        wdf = spark.createDataFrame(
            [(d, float(w), i) for i, (d, w) in enumerate(weights.items())],
            "domain string, weight double, _pos int",
        )
        table = lens.join(wdf, "domain")
        order = F.col("_pos")
    w = Window.partitionBy("split").orderBy(order)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy("split"))
    cum = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    tot = F.sum("weight").over(Window.partitionBy("split"))
    return table.select(
        "split",
        "domain",
        "_nw",
        (F.row_number().over(w) - 1).cast("long").alias("domain_id"),
        ((cum - F.col("weight")) / tot).alias("lo"),
        F.when(last, F.lit(1.0)).otherwise(cum / tot).alias("hi"),
    )


CELLS = 1024  # of the unit interval, to find the range that a draw falls into


def draw_domains(
    blocks: DataFrame | BlockStore,
    seq_len: int,
    batch_size: int,
    seed,
    weights: dict[str, float] | None = None,
    split: str = "train",
) -> DataFrame:
    """The draws of :func:`sample_domains_weighted` without their windows: no block is read.

    (split, domain, ``sample_id``, ``domain_id``, ``start``).
    """
    lens = stream_lengths(blocks).where(F.col("split") == split)
    spark = lens.sparkSession
    table = domain_weight_table(lens, weights, seq_len).where(F.col("lo") < F.col("hi"))
    cell = lambda u: F.floor(u * F.lit(CELLS)).cast("int")
    cells = F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))
    table = materialise(table.withColumn("_cell", F.explode(cells)), "domain-weights")
    if table.isEmpty():
        raise ValueError(f"no domain of split {split!r} has a window of length {seq_len}")
    draws = spark.range(batch_size).withColumnRenamed("id", "sample_id").withColumn(
        "_u", hash_uniform(seed, F.lit("domain"), "sample_id")
    )
    picked = draws.withColumn("_cell", cell(F.col("_u"))).join(table, "_cell")
    picked = picked.where((F.col("lo") <= F.col("_u")) & (F.col("_u") < F.col("hi")))
    picked = picked.withColumn(
        "start", hash_index(seed, F.col("_nw"), F.lit("window"), "sample_id") * F.lit(seq_len)
    )
    return picked.select("split", "domain", "sample_id", "domain_id", "start")


def sample_domains_weighted(
    blocks: DataFrame | BlockStore,
    block_len: int,
    seq_len: int,
    batch_size: int,
    seed,
    weights: dict[str, float] | None = None,
    split: str = "train",
) -> DataFrame:
    """Draw a domain per sample by weight (uniform by default), then a window in it.

    The draws join the weight table (half-open ranges ``lo <= u < hi``, a row per domain) on the cell
    of the unit interval that they fall into; a range stands in every cell that it meets. Output:
    ``sample_id, domain, domain_id, start, x, y``.
    """
    picked = draw_domains(blocks, seq_len, batch_size, seed, weights, split)
    got = _windows_from_draws(
        blocks, picked, block_len, seq_len, STREAM, ["sample_id", "domain_id"],
    )
    return got.drop("split")


def sample_with_domain_ids(
    blocks: DataFrame | BlockStore,
    block_len: int,
    seq_len: int,
    batch_size: int,
    seed,
    weights: dict[str, float] | None = None,
    split: str = "train",
    grouped: bool = False,
) -> DataFrame:
    """Weighted samples plus the domain id per sample and per token.

    ``grouped=True`` is the per-domain form: samples of one domain are placed
    in the same partition, ordered by sample id (a batch is small and bounded).
    """
    s = sample_domains_weighted(blocks, block_len, seq_len, batch_size, seed, weights, split)
    s = s.withColumn("token_domain_ids", F.array_repeat(F.col("domain_id"), seq_len))
    if grouped:
        s = s.repartition("domain_id").sortWithinPartitions("domain_id", "sample_id")
    return s


def epoch_batches(
    df: DataFrame,
    key_col: str,
    batch_size: int,
    epochs: int,
    seed,
    n_total: int,
    num_steps: int | None = None,
) -> DataFrame:
    """Rows reshuffled every epoch and cut into batches of ``min(b, ceil(n_total / 2))``.

    ``n_total`` is the row count before the train/val split (as the loaders
    size their batches). The short last batch is kept. Adds ``epoch``,
    ``batch``, ``pos`` (position inside the batch). With ``num_steps`` only the rows of that many batches
    remain: a threshold of the shuffle key cuts the epoch that is not used up, before any row is ranked.
    """
    bs = min(batch_size, math.ceil(n_total / 2))
    ex = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    ex = ex.withColumn("_key", seeded_key(seed, "epoch", key_col))
    if num_steps is not None:

        def used(n):
            steps = F.lit(num_steps) - F.col("epoch") * F.ceil(n / F.lit(bs))
            return F.least(n, F.greatest(F.lit(0), steps) * F.lit(bs))

        order = ["_key", key_col]
        ex = head_flag(ex, order, ["epoch"], hash_bucket("_key"), used, "_used", break_ties=True)
        ex = ex.where("_used").drop("_used")
    ranked = ordered_index(ex, ["_key", key_col], ["epoch"])
    return ranked.withColumn("batch", F.floor(F.col("_idx") / F.lit(bs)).cast("long")).withColumn(
        "pos", F.pmod(F.col("_idx"), F.lit(bs)).cast("long")
    ).drop("_key", "_idx", "_n")


def epochs_needed(n_rows: int, batch_size: int, n_total: int, num_steps: int) -> tuple[int, int]:
    """(batches per epoch, epochs) so that the schedule covers ``num_steps`` steps."""
    bs = min(batch_size, math.ceil(n_total / 2))
    per_epoch = max(1, math.ceil(n_rows / bs))
    return per_epoch, math.ceil(num_steps / per_epoch)


def batch_schedule(batches: DataFrame, num_steps: int, batches_per_epoch: int) -> DataFrame:
    """Global step per batch (``epoch * k + batch``), cut at ``num_steps``."""
    step = F.col("epoch") * F.lit(batches_per_epoch) + F.col("batch")
    return batches.withColumn("step", step.cast("long")).where(F.col("step") < F.lit(num_steps))
