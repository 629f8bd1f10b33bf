"""Minimax contiguous partition of ordered atomic groups into shards.

Groups are equal texts, ordered by their digest. The smallest feasible shard capacity is found by
binary search with a greedy check. The check runs on the driver over a summary of the order: segments
of the key space with their bytes. It is made twice, with segments of several groups taken as whole (the
capacity from above) and as divisible anywhere (from below). While the two differ, the segments at the cuts
are split further, by one aggregate over the groups table. A split reads back at most 2 ** STEP_BITS rows for each of
at most 6 segments a cut, whatever the number and sizes of the groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.prefix import range_prefix
from corpusflow.session import materialise

KEY_BITS = 60
FIRST_BITS = 12  # bits of the key in the first summary: 4096 rows at most
STEP_BITS = 8


class Segment(NamedTuple):
    """A range of 2 ** ``shift`` keys that holds ``groups`` groups, the largest of ``largest`` bytes."""

    start: int
    shift: int
    bytes: int
    groups: int
    largest: int

    @property
    def splits(self) -> bool:
        return self.groups > 1 and self.shift > 0


def _least(low: int, high: int, holds) -> int:
    """The least capacity in ``low`` .. ``high`` that holds, if ``high`` does and larger ones do whenever a smaller one does."""
    while low < high:
        mid = (low + high) // 2
        if holds(mid):
            high = mid
        else:
            low = mid + 1
    return low


def greedy_cuts(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each shard starts if every shard takes as much as it can; None if ``shards`` do not suffice."""
    ends = list(accumulate(sizes))
    cuts, at = [0], 0
    while True:
        limit = (ends[at - 1] if at else 0) + capacity
        to = bisect_right(ends, limit)
        if to >= len(sizes):
            return cuts
        if to == at or len(cuts) == shards:
            return None
        cuts.append(to)
        at = to


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which ``shards`` contiguous shards hold ``sizes``."""
    floor = max(max(sizes), -(-sum(sizes) // shards))
    return _least(floor, sum(sizes), lambda c: greedy_cuts(sizes, c, shards) is not None)


def _loose_cuts(segments: list[Segment], ends: list[int], capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """(segment, bytes before the cut) per cut, if segments of several groups could be cut anywhere; None if not feasible.

    No greedy run over the groups themselves gets further, so a capacity that fails here fails for the groups.
    """
    cuts, at = [], 0
    while at + capacity < ends[-1]:
        i = bisect_right(ends, at + capacity)
        at = at + capacity if segments[i].splits else ends[i] - segments[i].bytes
        cuts.append((i, at))
        if len(cuts) == shards:
            return None
    return cuts


def _next_splits(segments: list[Segment], shards: int) -> list[int]:
    """Segments to split next; none once cuts between segments reach the least capacity of the groups.

    The capacity of whole segments bounds the wanted one from above, that of loose cuts (and the largest
    group) from below. While they differ, some loose cut at the lower one lies inside a segment of several
    groups. Split are those, the ones where a run over whole segments stops, and their neighbours: a number
    that depends on ``shards`` alone.
    """
    ends = list(accumulate(s.bytes for s in segments))
    high = smallest_capacity([s.bytes for s in segments], shards)
    floor = max(-(-ends[-1] // shards), max(s.largest for s in segments))
    low = _least(floor, high, lambda c: _loose_cuts(segments, ends, c, shards) is not None)
    if low == high:
        return []
    near = {i for i, _ in _loose_cuts(segments, ends, low, shards)}
    at = 0
    for _ in range(shards - 1):
        i = bisect_right(ends, at + low)
        if i == len(ends):
            break
        near.add(i)
        at = max(ends[i] - segments[i].bytes, at)
    near |= {j for i in near for j in (i - 1, i + 1)}
    return sorted(i for i in near if 0 <= i < len(segments) and segments[i].splits)


def settle(first: list[Segment], finer, shards: int) -> list[int]:
    """Keys at which shards 1, 2, ... start. ``finer(segments)`` are the smaller segments that these consist of."""
    segments = sorted(first)
    if not segments:
        return []
    while open_ := _next_splits(segments, shards):
        gone = set(open_)
        parts = finer([segments[i] for i in open_])
        segments = sorted([s for i, s in enumerate(segments) if i not in gone] + parts)
    sizes = [s.bytes for s in segments]
    return [segments[i].start for i in greedy_cuts(sizes, smallest_capacity(sizes, shards), shards)[1:]]


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """Keys at which shards 1, 2, ... start. ``groups`` has (key, bytes), a row per group."""

    def summary(rows: DataFrame) -> list[Segment]:
        # Rows carry the shift of their segment; there are at most 2 ** STEP_BITS segments for each one that is split.
        part = rows.groupBy("shift", F.expr("shiftright(key, shift)").alias("p")).agg(
            F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m")
        )
        return [Segment(r["p"] << r["shift"], r["shift"], int(r["b"]), r["n"], r["m"]) for r in part.collect()]

    def finer(segments: list[Segment]) -> list[Segment]:
        shift = F.lit(None).cast("int")
        for old in {s.shift for s in segments}:
            starts = [s.start >> old for s in segments if s.shift == old]
            shift = F.when(F.shiftright("key", old).isin(starts), F.lit(max(0, old - STEP_BITS))).otherwise(shift)
        return summary(groups.withColumn("shift", shift).where("shift IS NOT NULL"))

    return settle(summary(groups.withColumn("shift", F.lit(KEY_BITS - FIRST_BITS))), finer, shards)


def minimax_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``size``, ``text_crc32``, ``shard`` and ``slot`` in the shard.

    Size is UTF-8 bytes plus 1. Null and empty texts are one group. Repeated rows are documents of
    their own, in one shard, with slots of their own. Null ids sort first. Other columns are ignored.
    No rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text)
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
            F.substring(digest, KEY_BITS // 4 + 1, 32).alias("rest"),
        ),
        "shard-docs",
    )
    groups = materialise(
        narrow.groupBy("key", "rest").agg(F.sum("size").alias("bytes")).select("key", "bytes"), "shard-groups"
    )
    shard = F.lit(0)
    for key in cut_keys(groups, shards):
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    ranked = range_prefix(
        narrow.withColumn("shard", shard),
        "shard",
        [F.col("key").asc(), F.col("rest").asc(), F.col("id").asc_nulls_first()],
        "size",
        "shard-slots",
    )
    return ranked.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("_row").alias("slot")
    )
