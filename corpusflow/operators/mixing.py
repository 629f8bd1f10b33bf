"""Stream-level set operations: concatenation, carving, block shuffles, noise, mixtures.

All operators work on block tables ``(split, domain, block_id, ids)`` (see
:mod:`corpusflow.operators.packing`). Per-stream facts (lengths, bases of a
concatenation) live in small tables with one row per stream; everything that
touches tokens is expressed as fragments re-grouped by target block, so no
task ever holds more than a block's worth of ids per fragment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.hashing import hash_index
from corpusflow.operators import gather, views
from corpusflow.operators.packing import fragments, regroup_blocks
from corpusflow.operators.views import bases, domain_order
from corpusflow.plans.generate import count_up
from corpusflow.plans.index import join_same
from corpusflow.session import materialise, tasks_for
from corpusflow.sources.blockstore import BlockStore, source_of

STREAM = ["split", "domain"]


def stream_lengths(blocks: DataFrame | BlockStore, part_cols: Sequence[str] = STREAM) -> DataFrame:
    """One row per stream: ``stream_len`` and ``n_blocks`` (a store has them; else a partial + final aggregate)."""
    if isinstance(blocks, BlockStore):
        return blocks.lengths()
    return blocks.groupBy(*part_cols).agg(
        F.sum(F.size("ids")).cast("long").alias("stream_len"), F.count(F.lit(1)).alias("n_blocks")
    )


def locate_blocks(blocks: DataFrame, block_len: int) -> DataFrame:
    """Block rows as located pieces: ``offset`` = first stream position, ``n_tokens``."""
    return blocks.withColumn("offset", F.col("block_id") * F.lit(block_len)).withColumn(
        "n_tokens", F.size("ids").cast("long")
    )


def rebase(pieces: DataFrame, block_len: int, part_cols: Sequence[str], n_tokens: int | None = None) -> DataFrame:
    """Pieces ``(part..., offset, n_tokens, ids)`` at new positions -> blocks of ``block_len`` (``n_tokens`` ids, if that is known)."""
    return regroup_blocks(fragments(pieces, block_len, part_cols), part_cols, n_tokens)


def concat_domains(
    tok_df: DataFrame,
    block_len: int,
    domains: Sequence[str] | None = None,
    order_cols: Sequence[str] = ("doc_id",),
    name: str = "all",
) -> DataFrame:
    """Concatenate the domain streams of each split, in list order, into one stream.

    One packing pass over the union: rows are range-partitioned by (domain
    ordinal, order columns) within the split. The ordinal table has one row per
    (split, domain).
    """
    from corpusflow.operators.packing import pack_blocks

    order_cols = list(order_cols)
    names = tok_df.select("split", "domain").distinct()
    # Written first, so that the planner knows how few they are and shuffles no ids to meet them.
    ords = materialise(domain_order(names, domains).select("split", "domain", "_ord"), "domain-order")
    rows = join_same(tok_df, ords, STREAM).withColumn("domain", F.lit(name))
    return pack_blocks(rows, block_len, STREAM, ["_ord", *order_cols])


def concat_streams(
    blocks: DataFrame, block_len: int, domains: Sequence[str] | None = None, name: str = "all"
) -> DataFrame:
    """The streams of each split that a block table holds, one after the other, as one stream."""
    view = views.concat(views.identity(stream_lengths(blocks)), domains, name)
    return views.read_view(blocks, view, block_len)


def train_one_eval_all(corpus: DataFrame, domain: str | Column) -> DataFrame:
    """Train rows of one domain, validation rows of every domain."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return corpus.where(
        ((F.col("split") == "train") & (F.col("domain") == d)) | (F.col("split") == "val")
    )


def head_blocks(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The first ``n_blocks`` blocks (= n * L tokens) of every stream."""
    return blocks.where(F.col("block_id") < F.lit(n_blocks))


def _per_split(sizes: int | Mapping[str, int]) -> Column:
    """A number for every split: the same for all, or by split name (null where not named)."""
    if isinstance(sizes, int):
        return F.lit(sizes).cast("long")
    if not sizes:
        return F.lit(None).cast("long")
    pairs = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return F.try_element_at(pairs, F.col("split")).cast("long")


def carve_view(
    lengths: DataFrame,
    block_len: int,
    n_blocks: int | Mapping[str, int],
    domains: Sequence[str] | None = None,
    mix_name: str = "mix",
    head: Mapping[str, int] | None = None,
    allow_overlap: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(what each stream keeps as ``_keep`` per stream, view of the ``mix`` stream) of :func:`carve_tail`."""
    L = F.lit(block_len)
    moved_len = F.coalesce(_per_split(n_blocks), F.lit(0)) * L
    lens = lengths.withColumn("_cut", F.greatest(F.col("stream_len") - moved_len, F.lit(0)))
    limit = F.col("stream_len") if allow_overlap else F.col("_cut")
    first = _per_split(head or {}) * L
    lens = lens.withColumn("_keep", F.when(first.isNotNull(), F.least(first, limit)).otherwise(F.col("_cut")))
    tails = lens.withColumn("_tail", F.col("stream_len") - F.col("_cut"))
    # Written first: the planner knows the size of this row per stream and chooses the joins by it.
    plan = materialise(bases(tails, "_tail", domains).select(*STREAM, "stream_len", "_cut", "_keep", "_base"), "carve-bases")
    whole = join_same(views.identity(plan), plan.drop("stream_len"), STREAM)
    tail = views.clip(whole, F.col("_cut"), F.col("at") + F.col("n"), F.col("_base"), F.lit(mix_name))
    return plan.select(*STREAM, "_keep"), tail


def kept_blocks(blocks: DataFrame, block_len: int, keep: DataFrame) -> DataFrame:
    """The first ``_keep`` tokens of each stream, in place."""
    L = F.lit(block_len)
    held = join_same(blocks.select(*STREAM, "block_id", "ids"), keep, STREAM).where(F.col("block_id") * L < F.col("_keep"))
    size = F.least(F.col("_keep") - F.col("block_id") * L, L)
    cut = F.slice("ids", F.lit(1), F.greatest(size, F.lit(0)).cast("int"))
    return held.select(*STREAM, "block_id", F.when(size < F.size("ids"), cut).otherwise(F.col("ids")).alias("ids"))


def carve_tail(
    blocks: DataFrame,
    block_len: int,
    n_blocks: int | Mapping[str, int],
    domains: Sequence[str] | None = None,
    mix_name: str = "mix",
    head: Mapping[str, int] | None = None,
    allow_overlap: bool = False,
) -> DataFrame:
    """Move the last ``n_blocks * L`` tokens of each stream into a shared ``mix`` stream.

    ``n_blocks`` may differ by split (a split that is not named moves nothing). The kept part of each
    stream stays at its positions (only the block that holds the cut is shortened); the carved tails are
    concatenated in domain order, as a view that is read once. A stream shorter than the tail moves whole.
    Of the splits in ``head`` only the first so many blocks are kept; with ``allow_overlap`` these may
    reach into the tail, whose tokens then stand in both.
    """
    keep, tail = carve_view(stream_lengths(blocks), block_len, n_blocks, domains, mix_name, head, allow_overlap)
    return kept_blocks(blocks, block_len, keep).unionByName(views.read_view(blocks, tail, block_len))


def shuffle_blocks(blocks: DataFrame, block_len: int, seed) -> DataFrame:
    """Permute the blocks of each stream (a short last block is permuted too).

    The new order is the rank of ``md5(seed:split:domain:block_id)``; new positions are
    a prefix sum of block sizes in that order, so a short block landing in the
    middle shifts the rest, exactly as concatenating the permuted slices does. Only block
    numbers are ordered; the ids move once, when the view is read.
    """
    return views.read_view(blocks, views.shuffle(views.identity(stream_lengths(blocks)), block_len, seed), block_len)


def _gather(
    blocks: DataFrame | BlockStore,
    spans: DataFrame,
    block_len: int,
    src_cols: Sequence[str],
    out_cols: Sequence[str],
    out_block_len: int | None = None,
) -> DataFrame:
    """Copy stream spans to new positions.

    ``spans``: (src_cols..., out_cols..., ``start``, ``length``, ``out_offset``).
    The spans are a written table (:func:`materialise`), so that they can be counted first.
    Each span is joined to the at most ceil(length/L)+1 source blocks it
    covers (an equi-join on block_id), sliced, and re-grouped by target block. Of a block store
    only the files that the spans touch are opened, so spans of a store are a batch.
    """
    L = F.lit(block_len)
    s, n = F.col("start"), F.col("length")
    first, last = F.floor(s / L), F.floor((s + n - 1) / L)
    spans = spans.where(n > 0)
    size = spans.agg(F.sum(last - first + 1).alias("parts"), F.sum(n).alias("tokens")).first()
    cover = spans.withColumn("block_id", F.explode(F.sequence(first, last).cast("array<long>")))
    cover = cover.withColumn("_block", F.struct(*src_cols, "block_id"))
    src = source_of(blocks, spans).select(F.struct(*src_cols, "block_id").alias("_block"), "ids")
    joined = views.meet_blocks(cover, src, size["parts"] or 0, size["tokens"])
    lo = F.greatest(s, F.col("block_id") * L)
    hi = F.least(s + n, (F.col("block_id") + 1) * L)
    pieces = joined.select(
        *out_cols,
        (F.col("out_offset") + lo - s).alias("offset"),
        (hi - lo).cast("long").alias("n_tokens"),
        F.slice("ids", (lo - F.col("block_id") * L + 1).cast("int"), (hi - lo).cast("int")).alias("ids"),
    )
    return rebase(pieces, out_block_len or block_len, out_cols, size["tokens"])


TARGET = "_target_split"


def _from_split(sizes: DataFrame, source_split: str | None) -> DataFrame:
    """``sizes`` with the split that is filled in ``TARGET`` and the one it is drawn from in ``split``.

    With a source the few rows are written first, so that its constant name stays a join key.
    """
    sizes = sizes.withColumn(TARGET, F.col("split"))
    if source_split is None:
        return sizes
    return materialise(sizes.withColumn("split", F.lit(source_split)), "draw-sizes")


def noise_tokens(
    blocks: DataFrame,
    block_len: int,
    sizes: DataFrame,
    seed,
    src_cols: Sequence[str] = STREAM,
    name: str = "noise",
    source_split: str | None = None,
) -> DataFrame:
    """``n`` tokens drawn independently, with replacement, from a stream (unigram noise).

    ``sizes``: (src_cols..., ``n``) -- how many tokens to draw from each stream.
    Draw ``j`` takes position ``hash_index(seed, stream_len, j)``; chunks of draws are gathered from slices of
    the stream as packed arrays (:mod:`corpusflow.operators.gather`), never as a row per token. With ``source_split``
    the draws of every split come from the stream of that one.
    """
    lens = stream_lengths(blocks, src_cols)
    plan = join_same(_from_split(sizes, source_split), lens, src_cols).where(F.col("stream_len") > 0)
    key_cols = [TARGET if c == "split" else c for c in src_cols]
    # A row per stream to fill, numbered; streams of one source share its number.
    source = F.dense_rank().over(Window.orderBy(*src_cols)).cast("long")
    plan = plan.withColumns({"stream": source, "target": F.row_number().over(Window.orderBy(*src_cols, TARGET)).cast("long")})
    plan = materialise(plan.withColumn("size", gather.chunk_size(F.col("stream_len"), block_len)), "noise-plan")
    chunks = count_up(plan, F.ceil(F.col("n") / F.col("size")), "chunk", chunk=16)
    first = F.col("chunk") * F.col("size")
    last = F.least(F.col("n"), first + F.col("size")) - 1
    positions = F.transform(F.sequence(first, last), lambda j: hash_index(seed, F.col("stream_len"), *key_cols, j))
    streams = plan.select(*src_cols, "stream").distinct()
    numbered = join_same(blocks.select(*src_cols, "block_id", "ids"), streams, src_cols)
    held = plan.select("stream", "stream_len").distinct().agg(F.sum("stream_len")).first()[0]
    got = gather.gather_tokens(
        numbered, chunks.withColumn("positions", positions), block_len, parts=tasks_for(blocks.sparkSession, held)
    )
    named = plan.select(F.col("target").alias("_t"), TARGET, "size")
    return got.join(named, F.col("target") == F.col("_t")).select(
        F.col(TARGET).alias("split"), F.lit(name).alias("domain"),
        (F.col("chunk") * F.floor(F.col("size") / block_len) + F.col("nth")).cast("long").alias("block_id"), "ids",
    )


def resample_spans(
    blocks: DataFrame,
    block_len: int,
    sizes: DataFrame,
    ctx_len: int,
    seed,
    src_cols: Sequence[str] = STREAM,
    out_cols: Sequence[str] = STREAM,
    name: str | None = None,
    source_split: str | None = None,
) -> DataFrame:
    """``n // ctx_len`` spans of ``ctx_len`` consecutive tokens from independent random starts.

    ``sizes``: (src_cols..., ``n``, optional ``out_base``). Span ``i`` starts at
    ``hash_index(seed, len - ctx_len + 1, stream, i)`` and lands at
    ``out_base + i * ctx_len``. Streams shorter than one span give nothing. With
    ``source_split`` the spans of every split come from the streams of that one.
    """
    lens = stream_lengths(blocks, src_cols)
    key_cols = [TARGET if c == "split" else c for c in src_cols]
    plan = join_same(_from_split(sizes, source_split), lens, src_cols).where(F.col("stream_len") >= F.lit(ctx_len))
    if "out_base" not in plan.columns:
        plan = plan.withColumn("out_base", F.lit(0).cast("long"))
    n_spans = F.floor(F.col("n") / F.lit(ctx_len)).cast("long")
    spans = count_up(plan, n_spans, "_i", chunk=4096)
    spans = spans.withColumn(
        "start", hash_index(seed, F.col("stream_len") - F.lit(ctx_len) + 1, *key_cols, "_i")
    ).withColumn("length", F.lit(ctx_len).cast("long")).withColumn(
        "out_offset", F.col("out_base") + F.col("_i") * F.lit(ctx_len)
    )
    out_cols = [TARGET if c == "split" else c for c in out_cols]
    if name is not None:
        spans, out_cols = spans.withColumn("_out_domain", F.lit(name)), [TARGET, "_out_domain"]
    # Written first: there may be many, and the planner would take them for as few as the streams.
    out = _gather(blocks, materialise(spans, "span-draws"), block_len, src_cols, out_cols)
    return out.withColumnsRenamed({TARGET: "split", "_out_domain": "domain"})


def mix_by_rate(
    blocks: DataFrame,
    block_len: int,
    budgets: DataFrame,
    rates: dict[str, float] | None = None,
    ctx_len: int = 1000,
    seed=0,
    name: str = "mix",
    source_split: str | None = None,
) -> DataFrame:
    """Mixture of streams: ``floor(n * rate_d)`` tokens from domain ``d``, as ``ctx_len`` spans.

    ``budgets``: (split, ``n``) total mixture length per split. ``rates`` maps
    domain -> rate (uniform over the domains present when omitted); streams are
    concatenated in rate-list order (or by name). Taking whole spans floors a
    second time, so the mixture can be shorter than asked. With ``source_split`` the
    mixture of every split is drawn from the streams of that one.
    """
    lens = stream_lengths(blocks)
    if rates is None:
        k = lens.groupBy("split").agg(F.count(F.lit(1)).alias("_k"))
        table = join_same(lens, k, ["split"]).withColumn("_rate", F.lit(1.0) / F.col("_k"))
        domains = None
    else:
        rate_df = blocks.sparkSession.createDataFrame(list(rates.items()), "domain string, _rate double")
        table = lens.join(rate_df, "domain")
        domains = list(rates)
    table = join_same(table, _from_split(budgets, source_split), ["split"]).withColumn(
        "n", F.floor(F.col("n") * F.col("_rate")).cast("long")
    )
    table = table.withColumn(
        "_used", F.floor(F.col("n") / F.lit(ctx_len)).cast("long") * F.lit(ctx_len)
    ).withColumn("_used", F.when(F.col("stream_len") >= F.lit(ctx_len), F.col("_used")).otherwise(0))
    with_base = bases(table, "_used", domains, TARGET).select(
        F.col(TARGET).alias("split"), "domain", "n", F.col("_base").alias("out_base")
    )
    return resample_spans(blocks, block_len, with_base, ctx_len, seed, name=name, source_split=source_split)
