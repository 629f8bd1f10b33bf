"""The flat token stream as a table of fixed-size blocks.

A stream is the concatenation, in order, of the ``ids`` of its documents.
Position ``p`` of a stream lives in block ``p div L`` at index ``p mod L``.
Blocks give random access (what a memory map offers) while every task only
handles bounded data: one row per document fragment, never one per token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.arrow import joined_ids, pack, packed_ids, unpack, unpacked_ids
from corpusflow.plans.index import join_same, ordered_index
from corpusflow.session import dealt, materialise, tasks_for


def token_offsets(
    tok_df: DataFrame,
    part_cols: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column | None = None,
    len_col: str = "n_tokens",
) -> DataFrame:
    """Start position (``offset``) of every document in its stream, plus ``stream_len``."""
    out = ordered_index(
        tok_df, order_cols, part_cols, bucket=bucket, weight=len_col,
        start_col="offset", total_col="stream_len",
    )
    return out.withColumnRenamed("_idx", "doc_index").drop("_n")


def shard_of(idx: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` numbering (0-based): sizes differ by at most one, larger first."""
    q = F.floor(n / F.lit(k)).cast("long")
    rem = (n - q * F.lit(k)).cast("long")
    big = rem * (q + 1)
    return F.when(idx < big, F.floor(idx / (q + 1))).otherwise(
        rem + F.floor((idx - big) / F.greatest(q, F.lit(1)))
    ).cast("long")


def shard_contiguous(
    df: DataFrame,
    k: int,
    order_cols: Sequence[str],
    part_cols: Sequence[str] = (),
    bucket: Column | None = None,
    shard_col: str = "shard",
) -> DataFrame:
    """Cut ordered rows into ``k`` contiguous shards; with k > rows, empty shards just vanish."""
    ranked = ordered_index(df, order_cols, part_cols, bucket=bucket)
    return ranked.withColumn(shard_col, shard_of(F.col("_idx"), F.col("_n"), k)).drop("_idx", "_n")


def fragments(
    located: DataFrame, block_len: int, part_cols: Sequence[str], offset_col: str = "offset"
) -> DataFrame:
    """One row per (document, block) overlap: ``block_id``, ``lo`` (stream position), ``frag``."""
    L = F.lit(block_len)
    s = F.col(offset_col)
    n = F.col("n_tokens")
    with_blocks = located.where(n > 0).withColumn(
        "block_id", F.explode(F.sequence(F.floor(s / L), F.floor((s + n - 1) / L)).cast("array<long>"))
    )
    lo = F.greatest(s, F.col("block_id") * L)
    hi = F.least(s + n, (F.col("block_id") + 1) * L)
    return with_blocks.select(
        *part_cols,
        "block_id",
        lo.alias("lo"),
        F.slice("ids", (lo - s + 1).cast("int"), (hi - lo).cast("int")).alias("frag"),
    )


#: Blocks of a stream whose fragments meet in one task.
STRETCH = 4096


def regroup_blocks(frags: DataFrame, part_cols: Sequence[str], n_tokens: int | None = None) -> DataFrame:
    """Concatenate fragments of each block in stream order (block size is bounded).

    The fragments are shuffled as packed ids, by stretches of blocks, so a task ends up with blocks that lie side by side.
    ``n_tokens`` says how many ids there are, if that is known: more tasks where there are many.
    """
    rows = frags.withColumns({"frag": packed_ids("frag"), "_stretch": F.floor(F.col("block_id") / STRETCH)})
    keys = [*part_cols, "_stretch"]
    rows = dealt(rows, tasks_for(frags.sparkSession, n_tokens), *keys)
    found = rows.groupBy(*keys, "block_id").agg(F.array_sort(F.collect_list(F.struct("lo", "frag"))).alias("_f"))
    return found.select(*part_cols, "block_id", joined_ids(F.transform("_f", lambda x: x["frag"])).alias("ids"))


#: Tokens of a run, and of the documents that a task joins at a time.
TOKENS_PER_RUN, BATCH_TOKENS = 1 << 16, 1 << 22


def _runs(part_cols: Sequence[str], run_len: int):
    """Sorted documents (part..., packed ids) to runs of ``run_len`` ids of one partition: (part..., ``_from``, ``n_tokens``, packed ``ids``)."""
    import numpy as np
    import pyarrow as pa

    def cut(batches):
        key, begin, held, size = None, 0, [], 0
        names = [*part_cols, "_from", "n_tokens", "ids"]

        def flush(whole_only):
            """Rows of the runs that are full (or of all that is held)."""
            nonlocal begin, held, size
            values = np.concatenate(held) if held else np.zeros(0, np.int32)
            end = size - size % run_len if whole_only else size
            at = np.append(np.arange(0, end, run_len), end) if end else np.zeros(1, np.int64)
            k = len(at) - 1
            rows = pa.RecordBatch.from_arrays(
                [
                    *(pa.array([v] * k, t) for v, t in zip(key, types)), pa.array(begin + at[:k].astype(np.int64)),
                    pa.array(np.diff(at).astype(np.int64)), pack(values[:end], at),
                ],
                names=names,
            )
            begin, held, size = begin + end, [values[end:].copy()] if end < size else [], size - end
            return rows

        for batch in batches:
            types = [batch.column(i).type for i in range(len(part_cols))]
            parts = list(zip(*(batch.column(i).to_pylist() for i in range(len(part_cols))))) or [()] * batch.num_rows
            ids, offsets = unpack(batch.column(len(part_cols)))
            edges = [i for i in range(1, len(parts)) if parts[i] != parts[i - 1]]
            for a, b in zip([0, *edges], [*edges, len(parts)]):
                if a == b:
                    continue
                if key is not None and parts[a] != key:
                    yield flush(False)
                    begin, held, size = 0, [], 0
                key = parts[a]
                while a < b:  # as many documents as make up a bounded batch
                    n = max(1, int(np.searchsorted(offsets[a : b + 1] - offsets[a], BATCH_TOKENS, "right")) - 1)
                    n = min(n, b - a)
                    values = ids[offsets[a] : offsets[a + n]]
                    held.append(values)
                    size += len(values)
                    a += n
                    if size >= run_len:
                        yield flush(True)
            held = [np.concatenate(held)] if held else []  # lets go of the batch
        if key is not None:
            yield flush(False)

    return cut


def count_tokens(tok_df: DataFrame) -> int:
    """How many ids a tokenised table holds, from its counts where it has them."""
    n = F.col("n_tokens") if "n_tokens" in tok_df.columns else F.size("ids")
    return tok_df.agg(F.sum(n).cast("long")).first()[0] or 0


def stream_runs(tok_df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str], run_len: int) -> DataFrame:
    """Streams as located runs: (part..., ``offset``, ``n_tokens``, ``stream_len``, ``ids``), at most ``run_len`` ids each.

    Documents cross one range shuffle (by partition, order and row number, so equal keys spread) with their ids packed, to as
    many tasks as sort them in memory, and one Arrow pass, which joins the ids of a sorted task to runs. What a task holds
    of a stream is summed up from the runs' lengths alone and tells where it begins.
    """
    part_cols, order_cols = list(part_cols), list(order_cols)
    n = tasks_for(tok_df.sparkSession, count_tokens(tok_df))
    keys = [*part_cols, *order_cols, "_uid"]
    rows = tok_df.select(*part_cols, *order_cols, packed_ids(F.coalesce("ids", F.array().cast("array<int>"))).alias("ids"))
    rows = rows.withColumn("_uid", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*part_cols, "ids")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in part_cols), "_from long, n_tokens long, ids binary"])
    runs = rows.mapInArrow(_runs(part_cols, run_len), schema).withColumn("_task", F.spark_partition_id())
    runs = materialise(runs, "stream-runs", "zstd")
    held = runs.groupBy(*part_cols, "_task").agg(F.sum("n_tokens").alias("_held"))
    whole = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select(
        *part_cols, "_task", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_held").over(whole).alias("stream_len"),
    )
    out = join_same(runs, materialise(bases, "run-bases"), [*part_cols, "_task"])
    at = (F.col("_base") + F.col("_from")).alias("offset")
    return out.select(*part_cols, at, "n_tokens", "stream_len", unpacked_ids("ids").alias("ids"))


def pack_blocks(
    tok_df: DataFrame,
    block_len: int,
    part_cols: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column | None = None,
    tokens_per_bucket: int = TOKENS_PER_RUN,
) -> DataFrame:
    """Tokenised documents -> ``(part..., block_id, ids)`` with ``block_len`` ids per block.

    Only the last block of a stream can be shorter. The streams come as runs of ``tokens_per_bucket``
    ids (:func:`stream_runs`); the blocks that lie inside a run are sliced from it, and only
    the fragments at the two ends of a run meet their neighbours in a second, small shuffle. ``bucket``, if
    given, is non-decreasing in ``order_cols`` and compared before them. Null ids count as no token.
    """
    if bucket is not None:
        tok_df, order_cols = tok_df.withColumn("_first_key", bucket), ["_first_key", *order_cols]
    runs = stream_runs(tok_df, part_cols, order_cols, tokens_per_bucket)
    return blocks_of_pieces(runs, block_len, list(part_cols))


def blocks_of_pieces(
    pieces: DataFrame, block_len: int, part_cols: Sequence[str], n_tokens: int | None = None
) -> DataFrame:
    """Located pieces ``(part..., offset, n_tokens, stream_len, ids)`` of streams -> their blocks.

    A block that lies inside a piece is sliced from it where it is; only what a piece holds of the blocks
    at its two ends is shuffled. The slices are made inside the generator, so a long piece is never
    copied for each of its blocks. ``n_tokens``: how many ids may stand at such ends, if that is known.
    """
    L = F.lit(block_len)
    a, z = F.col("offset"), F.col("offset") + F.col("n_tokens")
    first = F.ceil(a / L).cast("long")
    stop = F.when(z == F.col("stream_len"), F.ceil(z / L)).otherwise(F.floor(z / L)).cast("long")

    def cut(lo, hi):
        return F.slice("ids", (lo - a + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))

    def block(b):
        return F.struct(b.alias("block_id"), cut(b * L, F.least(z, (b + 1) * L)).alias("ids"))

    def fragment(b, lo, hi):
        return F.struct(b.alias("block_id"), lo.alias("lo"), cut(lo, hi).alias("frag"))

    held = pieces.where(F.col("n_tokens") > 0)
    inner = held.where(stop > first).withColumn("_b", F.explode(F.transform(F.sequence(first, stop - 1), block)))
    head = F.when(F.pmod(a, L) != 0, F.array(fragment(F.floor(a / L).cast("long"), a, F.least(z, first * L))))
    tail = F.when((stop >= first) & (stop * L < z), F.array(fragment(stop, stop * L, z)))
    none = F.array().cast("array<struct<block_id:bigint,lo:bigint,frag:array<int>>>")
    ends = held.withColumn("_b", F.explode(F.concat(F.coalesce(head, none), F.coalesce(tail, none))))
    return inner.select(*part_cols, "_b.block_id", "_b.ids").unionByName(
        regroup_blocks(ends.select(*part_cols, "_b.block_id", "_b.lo", "_b.frag"), part_cols, n_tokens)
    )


def pack_blocks_exploded(
    tok_df: DataFrame,
    block_len: int,
    part_cols: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column | None = None,
) -> DataFrame:
    """Same result as :func:`pack_blocks` with native operators only: every
    document is exploded into its block fragments, which are re-grouped by
    block (two shuffles of the tokens)."""
    located = token_offsets(tok_df, part_cols, order_cols, bucket=bucket)
    return regroup_blocks(fragments(located, block_len, part_cols), part_cols)


def concat_shard(
    df: DataFrame,
    shard_col: str,
    order_cols: Sequence[str],
    block_len: int = 1 << 16,
    part_cols: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """The ids of each shard, concatenated in order.

    A shard grows with the corpus, so its stream is returned as ordered
    pieces of at most ``block_len`` ids (``block_id`` within the shard), not as
    one array built in one task.
    """
    return pack_blocks(df, block_len, [*part_cols, shard_col], order_cols, bucket=bucket)


def context_tail(df: DataFrame, ids_col: str, length: int, out_col: str | None = None) -> DataFrame:
    """Keep only the last ``length`` ids of each sequence."""
    ids = F.col(ids_col)
    start = F.greatest(F.size(ids) - F.lit(length), F.lit(0)) + 1
    return df.withColumn(out_col or ids_col, F.slice(ids, start.cast("int"), F.lit(length)))


def block_summary(blocks: DataFrame, part_cols: Sequence[str], ids_col: str = "ids") -> DataFrame:
    """Scalar view of a block table for checks: size, first, last, positional checksum."""
    from corpusflow.functions.arrow import ids_stats

    return blocks.select(*part_cols, "block_id", ids_stats(F.col(ids_col)).alias("_s")).select(
        *part_cols, "block_id", "_s.n_tokens", "_s.first_id", "_s.last_id", "_s.checksum"
    )
