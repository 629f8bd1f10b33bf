"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints within ``distance`` bits agree in one of ``distance + 1`` segments. Fingerprints are
dealt out by (segment, value); each such group is the subtrie below a common prefix, once the segment is
rotated to the top. Within it, pairs of trie nodes are traversed together from the top bit down: every
pair carries the bits in which its nodes differ, and is dropped when they exceed the distance. A group
too large for a task is first split by the next bits into pairs of child prefixes, which are the same
node pairs a few levels further down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusflow.llm.columns import passing
from corpusflow.llm.graph import components, merge
from corpusflow.llm.textbytes import tidy
from corpusflow.session import materialise

SEED = 42
MAX_GROUP = 50_000  # fingerprints that one subtrie may have before it is split
SPLIT_BITS = 6
MAX_PAIRS = 100_000  # node pairs held at a time


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(joined)]
    spans = zip(starts, ends[words_per_shingle - 1 :]) if len(tokens) >= words_per_shingle else [(0, len(joined))]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str, words_per_shingle: int, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of every whole text, as a signed long."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(at)]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, LongType())]))


def trie_pairs(values: np.ndarray, runs: np.ndarray, depth: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sorted distinct ``values`` within ``distance`` bits, below the nodes ``runs``.

    ``runs`` has rows (a_lo, a_hi, b_lo, b_hi, errors): pairs of trie nodes as ranges of ``values``,
    at ``depth`` bits from the top.
    """
    stack = [(depth, runs)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > MAX_PAIRS:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        alone = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if alone.any():  # leaves: the rest of their path at once
            leaf = pairs[alone]
            i, j = leaf[:, 0], leaf[:, 2]
            near = (np.bitwise_count(values[i] ^ values[j]) <= distance) & (i != j)
            if near.any():
                yield i[near], j[near]
            pairs = pairs[~alone]
        if not len(pairs) or depth == 64:
            continue
        bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        split = lambda lo, hi: hi - (ones[hi] - ones[lo])  # noqa: E731  where the node's 1-child begins
        a_lo, a_hi, b_lo, b_hi, e = pairs.T
        a_mid, b_mid = split(a_lo, a_hi), split(b_lo, b_hi)
        other = a_lo != b_lo  # a node with itself has one mixed pair of children, not two
        children = [
            np.stack([a_lo, a_mid, b_lo, b_mid, e], axis=1),
            np.stack([a_mid, a_hi, b_mid, b_hi, e], axis=1),
            np.stack([a_lo, a_mid, b_mid, b_hi, e + 1], axis=1),
            np.stack([a_mid, a_hi, b_lo, b_mid, e + 1], axis=1)[other],
        ]
        pairs = np.concatenate(children)
        some = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= distance)
        itself = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] == 1)
        if len(pairs := pairs[some & ~itself]):
            stack.append((depth + 1, pairs))


def _rotated(segment_starts: list[int]):
    """Column of ``fp`` with its segment ``seg`` at the top, signed."""
    turned = F.col("fp")
    for k, s in enumerate(segment_starts):
        if s:
            turn = F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s))
            turned = F.when(F.col("seg") == k, turn).otherwise(turned)
    return turned


def links(fps: DataFrame, distance: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b) edges between distinct fingerprints ``fp`` that connect all within ``distance`` bits.

    Each task gives a spanning forest of the links that it finds, so a dense group costs as many rows
    as it has fingerprints.
    """
    n = distance + 1
    starts = [64 * k // n for k in range(n)]
    bits = min(e - s for s, e in zip(starts, [*starts[1:], 64]))
    rows = fps.select("fp", F.explode(F.array(*(F.lit(k) for k in range(n)))).alias("seg"))
    rows = rows.withColumn("r", _rotated(starts))
    prefix = F.shiftrightunsigned("r", 64 - bits)
    rows = rows.select("fp", "seg", "r", F.lit(bits).alias("depth"), prefix.alias("p"), prefix.alias("q"))
    group = ["seg", "depth", "p", "q"]
    ready = None
    while True:
        rows = materialise(rows, "trie-rows")
        large = materialise(
            rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > max_group) & (F.col("depth") < 64)),
            "trie-large",
        )
        if large.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        large = large.drop("n")
        whole = rows.join(large, group, "left_anti")
        ready = whole if ready is None else ready.unionByName(whole)
        rows = _split(rows.join(large, group), distance)
    return ready.repartition(*group).sortWithinPartitions(*group, "r").mapInArrow(
        tidy(lambda batches: _join(batches, distance)), "a long, b long"
    )


def _split(rows: DataFrame, distance: int) -> DataFrame:
    """Groups (p, q) as groups of pairs of child prefixes, each fingerprint in those that it can match in."""
    depth = F.least(F.col("depth") + SPLIT_BITS, F.lit(64))
    rows = rows.withColumn("_bits", depth - F.col("depth")).withColumn("depth", depth)
    rows = rows.withColumn("_own", F.expr("shiftrightunsigned(r, 64 - depth)"))
    masks = F.array(*(F.lit(m) for m in range(1 << SPLIT_BITS) if m.bit_count() <= distance))
    rows = rows.withColumn("_mask", F.explode(masks)).where(F.expr("shiftright(_mask, _bits) = 0"))
    left = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) + F.bit_count("_mask")
    rows = rows.where(left <= distance)
    # In a group of two prefixes the partner lies below the other one.
    rows = rows.withColumn("_turn", F.expr("shiftleft(p ^ q, _bits) ^ CAST(_mask AS BIGINT)"))
    rows = rows.withColumn("_other", F.col("_own").bitwiseXOR(F.col("_turn")))
    return rows.select(
        "fp", "seg", "r", "depth", F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q")
    )


def _join(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a task. Rows are sorted by group, so whole groups pass through."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(parts: list[pa.RecordBatch], last: bool):
        table = pa.Table.from_batches(parts).combine_chunks()
        cols = [np.asarray(table[c]) for c in ("seg", "depth", "p", "q")]
        new = np.zeros(len(table), dtype=bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        stop = len(table) if last else int(at[-1])  # the last group may go on in the next batch
        keep = [] if last else pa.Table.to_batches(table.slice(stop).combine_chunks())
        if stop:
            bounds = np.append(at[at < stop], stop)
            yield from _groups(table.slice(0, stop), bounds, distance)
        return keep

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 2 * MAX_GROUP:
            held = yield from flush(held, False)
            rows = sum(b.num_rows for b in held)
    if held:
        yield from flush(held, True)


def _groups(table: pa.Table, bounds: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    fp = np.asarray(table["fp"])
    values = np.asarray(table["r"]).view(np.uint64)
    depth, p, q = (np.asarray(table[c])[bounds[:-1]] for c in ("depth", "p", "q"))
    lo, hi = bounds[:-1], bounds[1:]
    labels = np.arange(len(fp))
    for d in np.unique(depth).tolist():
        own = depth == d
        prefix = values >> np.uint64(64 - d) if d < 64 else values
        nodes = []
        one = own & (p == q) & (hi - lo > 1)
        nodes.append(np.stack([lo[one], hi[one], lo[one], hi[one], np.zeros(one.sum(), np.int64)], axis=1))
        two = np.flatnonzero(own & (p != q))
        if len(two):
            # The group is sorted by r, so its two prefixes are two ranges.
            same = prefix == np.repeat(prefix[lo], hi - lo)
            head = np.add.reduceat(same.astype(np.int64), lo)[two]
            mid = lo[two] + head
            errors = np.bitwise_count((p[two] ^ q[two]).view(np.uint64)).astype(np.int64)
            both = np.stack([lo[two], mid, mid, hi[two], errors], axis=1)
            nodes.append(both[mid < hi[two]])
        runs = np.concatenate(nodes).astype(np.int64)
        for i, j in trie_pairs(values, runs, d, distance):
            merge(labels, i, j)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], names=["a", "b"])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    distance: int = 2,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """A row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents are linked if their fingerprints differ in ``distance`` bits or fewer; the component is
    the smallest id that can be reached. Texts are lower-cased in A-Z; fewer words than a shingle
    make one shingle; null and empty texts have fingerprint zero and are linked like others.
    Repeated rows stay; null ids are never the smallest unless a component has no other. Other
    columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = materialise(with_fingerprint(narrow, "text", words_per_shingle).drop("text"), "simhash-docs")
    fps = materialise(own.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    found = materialise(components(links(fps, distance, max_group)), "simhash-components")
    named = found.join(fps, found["node"] == fps["fp"]).select("fp", "root", "first")
    least = materialise(named.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component")), "simhash-least")
    grouped = found.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component")
    # Written before the join with the documents, so that Spark can split a fingerprint with many.
    labelled = fps.join(materialise(grouped, "simhash-grouped"), F.col("fp") == F.col("_node"), "left")
    labelled = labelled.select(F.col("fp").alias("_fp"), F.coalesce("component", "first").alias("component_id"))
    labelled = materialise(labelled, "simhash-labels")
    return own.join(labelled, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, distance: int = 2
) -> DataFrame:
    """One row of each group of near duplicates: that of the least id, with all its columns.

    Rows that repeat an id, or have none, are told apart by their fingerprints: one row of a group stays
    even if several have its least id; of groups without any id, one row of each fingerprint stays. Null and
    empty texts are near duplicates of each other. Other columns pass through, whatever their names.
    """
    return passing(docs, (id_col, text_col), lambda d: _one_of_each(d, id_col, text_col, words_per_shingle, distance))


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, distance: int) -> DataFrame:
    found = materialise(near_duplicates(docs, id_col, text_col, words_per_shingle, distance), "simhash-found")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"))
    odd = found.groupBy(F.col(id_col).alias("_odd")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR _odd IS NULL")
    odd = materialise(odd.select("_odd"), "simhash-odd")
    plain = docs.join(materialise(gone.distinct(), "simhash-gone"), F.col(id_col) == F.col("_gone"), "left_anti")
    if odd.isEmpty():
        return plain
    plain = plain.where(F.col(id_col).isNotNull()).join(odd, F.col(id_col) == F.col("_odd"), "left_anti")
    labels = found.select(F.col("fingerprint").alias("_hex"), F.col("component_id").alias("_component")).distinct()
    rows = with_fingerprint(docs.join(odd, F.col(id_col).eqNullSafe(F.col("_odd")), "left_semi"), text_col, words_per_shingle, "_fp")
    rows = rows.withColumn("_own", F.lpad(F.lower(F.hex("_fp")), 16, "0")).join(labels, F.col("_own") == F.col("_hex"))
    rows = rows.where(F.col(id_col).eqNullSafe(F.col("_component")))
    apart = F.when(F.col("_component").isNull(), F.col("_hex"))
    nth = F.row_number().over(Window.partitionBy("_component", apart).orderBy("_hex", F.md5(text_col)))
    return plain.unionByName(rows.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns))
