"""Corpora composed of other corpora, as block tables ``(split, domain, block_id, ids)``.

Each keeps the domain streams and adds one stream: all domains in a row, noise, a mixture, or shuffled
tails. Only the added stream is shuffled; the domains' own blocks are passed on where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrow import packed_ids, unpacked_ids
from corpusflow.operators import views
from corpusflow.operators.mixing import (
    carve_view,
    concat_streams,
    kept_blocks,
    mix_by_rate,
    noise_tokens,
    stream_lengths,
)
from corpusflow.session import materialise


def with_all(
    blocks: DataFrame, block_len: int, head: Mapping[str, int] | None = None, domains: Sequence[str] | None = None
) -> DataFrame:
    """Domain streams and their concatenation ``all``; splits in ``head`` keep so many blocks of each domain."""
    if head:
        limit = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in head.items()])
        blocks = blocks.where(limit.isNull() | (F.col("block_id") < limit))
    return blocks.unionByName(concat_streams(blocks, block_len, domains))


def with_noise(
    blocks: DataFrame, block_len: int, budgets: DataFrame, seed, source_split: str | None = "train"
) -> DataFrame:
    """Domain streams and ``noise``: tokens drawn from the concatenation of all domains of ``source_split``.

    ``budgets`` has (split, ``n``); None draws each split from its own domains.
    """
    source = blocks if source_split is None else blocks.where(F.col("split") == source_split)
    everything = concat_streams(source, block_len).withColumn("ids", packed_ids("ids"))
    everything = materialise(everything, "noise-source", "zstd").withColumn("ids", unpacked_ids("ids"))
    sizes = budgets.withColumn("domain", F.lit("all"))
    return blocks.unionByName(noise_tokens(everything, block_len, sizes, seed, source_split=source_split))


def with_mixture(
    blocks: DataFrame,
    block_len: int,
    budgets: DataFrame,
    rates: dict[str, float] | None = None,
    ctx_len: int = 1000,
    seed=0,
    source_split: str | None = "train",
) -> DataFrame:
    """Domain streams and ``mix``: spans of the domains of ``source_split`` by rate, for every split."""
    mix = mix_by_rate(blocks, block_len, budgets, rates, ctx_len, seed, source_split=source_split)
    return blocks.unionByName(mix)


def with_shuffled_tails(
    blocks: DataFrame,
    block_len: int,
    n_blocks: int | Mapping[str, int],
    seed,
    head: Mapping[str, int] | None = None,
    allow_overlap: bool = False,
    domains: Sequence[str] | None = None,
) -> DataFrame:
    """Domain streams without their tails, and ``mix``: the tails of all domains, shuffled by block.

    Carving and shuffling are composed as views, so the ids of the tails move once.
    """
    keep, tail = carve_view(stream_lengths(blocks), block_len, n_blocks, domains, "mix", head, allow_overlap)
    mixed = views.read_view(blocks, views.shuffle(tail, block_len, seed), block_len)
    return kept_blocks(blocks, block_len, keep).unionByName(mixed)
