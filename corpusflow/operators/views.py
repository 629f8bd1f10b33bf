"""Streams as views: small tables of intervals that say where their tokens lie in other streams.

A view has a row per interval: (split, domain, ``at``) is where it stands in the new stream, (``s_split``, ``s_domain``,
``start``) where its ``n`` tokens lie in a block table. Cutting, joining and shuffling streams only rewrites
intervals, so operations compose without moving a token; ``read_view`` moves the ids once, at the end. Interval tables have a row per
stream, or per shuffled block, and no ids; they are written before they are joined, so the planner knows their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.arrow import packed_ids, unpacked_ids
from corpusflow.functions.hashing import seeded_key
from corpusflow.operators.packing import blocks_of_pieces
from corpusflow.plans.index import join_same, ordered_index
from corpusflow.session import dealt, materialise, tasks_for

STREAM = ["split", "domain"]
SOURCE = ["s_split", "s_domain"]
VIEW = [*STREAM, "at", *SOURCE, "start", "n"]


def identity(lengths: DataFrame) -> DataFrame:
    """Every stream of (split, domain, stream_len) as it is."""
    return lengths.where("stream_len > 0").select(
        *STREAM, F.lit(0).cast("long").alias("at"), F.col("split").alias("s_split"), F.col("domain").alias("s_domain"),
        F.lit(0).cast("long").alias("start"), F.col("stream_len").cast("long").alias("n"),
    )


def lengths_of(view: DataFrame) -> DataFrame:
    """(split, domain, ``stream_len``) of a view's streams."""
    return view.groupBy(*STREAM).agg(F.sum("n").alias("stream_len"))


def clip(view: DataFrame, low: Column, high: Column, base: Column | None = None, domain: Column | None = None) -> DataFrame:
    """Positions ``low`` to ``high`` (over the view's columns) of each stream, as a stream that starts at ``base`` (default ``low``)."""
    first = F.greatest("at", low)
    n = F.least(F.col("at") + F.col("n"), high) - first
    shift = F.lit(0) if base is None else base - low
    cut = view.withColumns({"_n": n, "_first": first, "_at": first + shift, "_domain": F.col("domain") if domain is None else domain})
    return cut.where("_n > 0").select(
        "split", F.col("_domain").alias("domain"), F.col("_at").alias("at"), *SOURCE,
        (F.col("start") + F.col("_first") - F.col("at")).alias("start"), F.col("_n").alias("n"),
    )


def domain_order(names: DataFrame, domains: Sequence[str] | None, split_col="split") -> DataFrame:
    """Ordinal of every domain: list order if given, else by name, null first (a row per stream)."""
    if domains is not None:
        order = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
        return names.where(F.col("domain").isin(list(domains))).withColumn("_ord", order.cast("long"))
    w = Window.partitionBy(split_col).orderBy("domain")
    return names.withColumn("_ord", F.dense_rank().over(w).cast("long"))


def bases(sizes: DataFrame, size_col: str, domains, split_col="split") -> DataFrame:
    """Exclusive running sum of per-domain sizes in domain order, per split (a row per stream)."""
    ordered = domain_order(sizes, domains, split_col)
    w = Window.partitionBy(split_col).orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn("_base", F.coalesce(F.sum(size_col).over(w), F.lit(0)).cast("long"))


def concat(view: DataFrame, domains: Sequence[str] | None = None, name: str = "all") -> DataFrame:
    """The streams of each split, one after the other, as one stream."""
    at = materialise(bases(lengths_of(view), "stream_len", domains).select(*STREAM, "_base"), "concat-bases")
    shifted = join_same(view, at, STREAM)
    return shifted.select(
        "split", F.lit(name).alias("domain"), (F.col("at") + F.col("_base")).alias("at"), *SOURCE, "start", "n"
    )


def shuffle(view: DataFrame, block_len: int, seed) -> DataFrame:
    """The blocks of each stream (the short last one too) in the order of ``md5(seed:split:domain:block_id)``."""
    L = F.lit(block_len)
    ends = lengths_of(view).withColumn("n_blocks", F.ceil(F.col("stream_len") / L).cast("long"))
    blocks = ends.withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    size = F.least(L, F.col("stream_len") - F.col("block_id") * L)
    keyed = blocks.select(*STREAM, "block_id", size.alias("_size"), seeded_key(seed, *STREAM, "block_id").alias("_key"))
    placed = ordered_index(keyed, ["_key", "block_id"], STREAM, weight="_size", start_col="_to")
    placed = materialise(placed.select(*STREAM, "block_id", "_to"), "shuffled-blocks")
    cut = _at_multiples(view, F.col("at"), block_len, "block_id", "_off")
    moved = join_same(cut, placed, [*STREAM, "block_id"])
    return moved.select(
        *STREAM, (F.col("_to") + F.col("at") + F.col("_off") - F.col("block_id") * L).alias("at"), *SOURCE,
        (F.col("start") + F.col("_off")).alias("start"), F.col("_m").alias("n"),
    )


def _at_multiples(view: DataFrame, pos: Column, block_len: int, block_col: str, off_col: str) -> DataFrame:
    """Intervals cut where ``pos`` passes a multiple of ``block_len``: its block, the part's offset and length ``_m``."""
    L = F.lit(block_len)
    first, last = F.floor(pos / L), F.floor((pos + F.col("n") - 1) / L)
    cut = view.withColumn(block_col, F.explode(F.sequence(first, last)))
    off = F.greatest(F.lit(0), F.col(block_col) * L - pos)
    return cut.withColumn(off_col, off).withColumn("_m", F.least(F.col("n"), (F.col(block_col) + 1) * L - pos) - off)


def read_view(blocks: DataFrame, view: DataFrame, block_len: int, source_len: int | None = None) -> DataFrame:
    """The blocks (split, domain, block_id, ids) of a view over a block table whose blocks hold ``source_len`` ids.

    Where a stream is read in a few intervals, these go to its blocks. Else the intervals are cut at the blocks they read and
    meet them by block. Only parts of a block are shuffled to their place, a block that is found whole stays where it is.
    """
    source_len = source_len or block_len
    view = materialise(join_same(view, lengths_of(view), STREAM), "view")
    first, last = F.floor(F.col("start") / source_len), F.floor((F.col("start") + F.col("n") - 1) / source_len)
    by_stream = view.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("k"), F.sum(last - first + 1).alias("parts"), F.sum("n").alias("tokens"))
    n = by_stream.agg(F.max("k").alias("k"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens")).first()
    if (n["k"] or 0) <= INTERVALS:
        source = blocks.select(F.col("split").alias("_b_split"), F.col("domain").alias("_b_domain"), (F.col("block_id") * source_len).alias("_pos"), "ids")
        same = F.col("s_split").eqNullSafe(F.col("_b_split")) & F.col("s_domain").eqNullSafe(F.col("_b_domain"))
        low = F.greatest("start", "_pos")
        found = source.join(F.broadcast(view), same).withColumns(
            {"_from": low - F.col("_pos"), "offset": F.col("at") + low - F.col("start"), "n_tokens": F.least(F.col("start") + F.col("n"), F.col("_pos") + source_len) - low}
        ).where("n_tokens > 0")
    else:
        source = blocks.select(F.struct("split", "domain", "block_id").alias("_block"), "ids")
        parts = _at_multiples(view, F.col("start"), source_len, "s_block", "_off").select(
            *STREAM, F.struct(*SOURCE, "s_block").alias("_block"), (F.col("at") + F.col("_off")).alias("offset"),
            (F.col("start") + F.col("_off") - F.col("s_block") * source_len).alias("_from"), F.col("_m").alias("n_tokens"), "stream_len",
        )
        found = meet_blocks(parts, source, n["parts"], n["tokens"])
    pieces = found.select(
        *STREAM, "offset", "n_tokens", "stream_len",
        F.slice("ids", (F.col("_from") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids"),
    )
    return blocks_of_pieces(pieces, block_len, STREAM, n["tokens"])


#: Intervals of a stream that each of its blocks is compared with.
INTERVALS = 64
#: Parts that are sent to every task instead of being shuffled with the blocks.
FEW = 1 << 16


def meet_blocks(parts: DataFrame, source: DataFrame, n_parts: int, n_tokens: int | None) -> DataFrame:
    """Parts joined to the blocks (``_block``, ``ids``) that they read, by the struct ``_block`` (its null fields are equal).

    Few parts go to the blocks. Else both are shuffled, the ids packed, to as many tasks as sort them in memory.
    """
    if n_parts <= FEW:
        return source.join(F.broadcast(parts), "_block").drop("_block")
    n = tasks_for(parts.sparkSession, n_tokens)
    source = source.withColumn("ids", packed_ids("ids"))
    found = dealt(parts, n, "_block").join(dealt(source, n, "_block"), "_block")
    return found.withColumn("ids", unpacked_ids("ids")).drop("_block")
