"""Hard-negative mining by inner products over STR-packed R-trees.

Vectors are range-partitioned by label and their widest coordinate, which are the first slabs of a sort-tile-recursive
packing; each task goes on with the other coordinates, label by label, down to leaves of a few vectors, and writes
its tree. The box of a node bounds the inner product of every vector below it with an anchor, coordinate by coordinate.

Anchors go in blocks to the trees whose root boxes they cannot rule out. There each of them works a queue, the box with
the greatest upper bound first: boxes outside the score windows, or strictly below the k-th score found so far, are never
opened. The best few of every tree meet in a window function over (anchor, positive). Positives come first: their
scores are the windows of the negatives. Trees and blocks are bounded; anchors stream past a tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.textbytes import tidy
from corpusflow.session import materialise

LEAF, FANOUT = 32, 16
TREE_ROWS, BLOCK_ROWS = 16_384, 256
LEAST, MOST = -(2**63), 2**63 - 1
#: Sums of products up to here are exact in double precision; beyond it they are taken as 64-bit integers.
EXACT = 2**53


class Tree(NamedTuple):
    """Nodes in order from the root; node i holds rows first[i]:stop[i], children child[i]:child_stop[i] (none: a leaf)."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    child_stop: np.ndarray


def str_pack(vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, Tree]:
    """(order of the rows, tree) of a sort-tile-recursive packing of some vectors.

    A node's rows are sorted by the coordinate that spreads most among them, then id, and cut into at most FANOUT
    runs of equal length, until a run fits a leaf.
    """
    order = np.arange(len(vectors))
    nodes, queue = [], [(0, len(vectors))]
    children = []
    for first, stop in queue:
        rows = vectors[order[first:stop]]
        low, high = rows.min(axis=0), rows.max(axis=0)
        nodes.append((low, high, first, stop))
        n = stop - first
        if n <= LEAF or (low == high).all():
            children.append((0, 0))
            continue
        wide = int(np.argmax(high - low))
        order[first:stop] = order[first:stop][np.lexsort((ids[order[first:stop]], rows[:, wide]))]
        runs = min(FANOUT, -(-n // LEAF))
        cuts = [first + n * i // runs for i in range(runs + 1)]
        children.append((len(queue), len(queue) + runs))
        queue += list(zip(cuts, cuts[1:]))
    low, high, first, stop = (np.asarray(x) for x in zip(*nodes))
    child, child_stop = np.asarray(children).T
    return order, Tree(low, high, first, stop, child, child_stop)


def bounds(low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of an anchor with any vector of each box: the sum of every coordinate's interval."""
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    return low @ up + high @ down, high @ up + low @ down


def search(tree: Tree, vectors, ids, uids, anchor, windows: list, k: int, own: int | None = None) -> list[list]:
    """For every window (least, greatest score) the first k (-score, id, uid): greatest score, then least id; ``own`` is left out.

    The floors of the windows only rise: a box is opened if it can hold a score inside some window
    and not strictly below the k-th found there.
    """
    found = [[] for _ in windows]
    floors = [least for least, _ in windows]
    most = max(m for _, m in windows)
    low, high = bounds(tree.low[:1], tree.high[:1], anchor)
    queue = [(-high[0], 0, low[0])]
    while queue:
        top, node, least = heapq.heappop(queue)
        if -top < min(floors):
            break  # all other boxes are below as well
        if not any(-top >= floor and least <= m for floor, (_, m) in zip(floors, windows)):
            continue
        a, b = tree.child[node], tree.child_stop[node]
        if a < b:
            lows, highs = bounds(tree.low[a:b], tree.high[a:b], anchor)
            for i in np.flatnonzero((highs >= min(floors)) & (lows <= most)):
                heapq.heappush(queue, (-highs[i], a + i, lows[i]))
            continue
        first, stop = tree.first[node], tree.stop[node]
        scores = vectors[first:stop] @ anchor
        fit = np.flatnonzero((scores >= min(floors)) & (scores <= most))
        if not len(fit):
            continue
        rows = [(-s, i, u) for s, i, u in zip(scores[fit].tolist(), ids[first:stop][fit].tolist(), uids[first:stop][fit].tolist()) if u != own]
        for w, (_, greatest) in enumerate(windows):
            new = [r for r in rows if floors[w] <= -r[0] <= greatest]
            if new:
                found[w] = heapq.nsmallest(k, found[w] + new)
                if len(found[w]) == k:
                    floors[w] = max(floors[w], -found[w][-1][0])
    return found


def quantised(vector: Column, scale: int) -> Column:
    """Every component x as floor(scale * x), x as double; null if the vector or a component is null or not finite."""
    xs = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)), xs)


#: Trees and blocks of anchors; a block has no ``tree`` and, per anchor, the ``floors`` of its positives.
PACKED = (
    "kind string, key long, dim int, label long, low array<long>, high array<long>, ids array<long>, uids array<long>, "
    "vectors binary, tree array<binary>, floors array<long>"
)
EXTENT = "dim int, at int, low long, high long"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, coordinate, least, greatest) of a task's vectors."""
    boxes = {}
    for batch in batches:
        column = batch.column(0)
        sizes = np.diff(np.asarray(column.offsets))
        for dim in np.unique(sizes).tolist():
            rows = column.filter(pa.array(sizes == dim))
            m = np.asarray(rows.flatten(), dtype=np.int64).reshape(-1, dim)
            low, high = boxes.get(dim, (m[0], m[0]))
            boxes[dim] = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
    rows = [(d, i, int(lo), int(hi)) for d, box in boxes.items() for i, (lo, hi) in enumerate(zip(*box))]
    yield _batch(rows, _arrow_extent())


def _arrow_extent() -> pa.Schema:
    return pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])


def _numbers(m: np.ndarray, exact: bool) -> np.ndarray:
    return m if exact else m.astype(np.float64)


def _pack(schema: pa.Schema, exact: bool, positives: int):
    """Sorted (dim, label, vec_id, uid, anchor, vector) to trees of one dim and label each, and blocks of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_keys = TaskContext.get().partitionId() << 32, 0

        def flush(key, parts):
            nonlocal n_keys
            ids, uids, anchors = (np.concatenate([p[i] for p in parts]) for i in range(3))
            vectors = np.concatenate([p[3] for p in parts])
            order, tree = str_pack(vectors, ids)
            ids, uids, anchors, vectors = ids[order], uids[order], anchors[order], vectors[order]
            out = [(
                "tree", base + n_keys, *key, tree.low[0].tolist(), tree.high[0].tolist(), ids.tolist(), uids.tolist(),
                vectors.tobytes(), [np.asarray(x, np.int64).tobytes() for x in tree], None,
            )]
            n_keys += 1
            numbers = _numbers(vectors, exact)
            mine = Tree(_numbers(tree.low, exact), _numbers(tree.high, exact), *tree[2:])
            chosen = np.flatnonzero(anchors)
            for i in range(0, len(chosen), BLOCK_ROWS):
                at = chosen[i : i + BLOCK_ROWS]
                floors = []
                for a in at:
                    near = search(mine, numbers, ids, uids, numbers[a], [(LEAST, MOST)], positives, int(uids[a]))[0]
                    floors.append(int(-near[-1][0]) if len(near) == positives else LEAST)
                box = vectors[at]
                out.append((
                    "anchors", base + n_keys, *key, box.min(axis=0).tolist(), box.max(axis=0).tolist(),
                    ids[at].tolist(), uids[at].tolist(), box.tobytes(), None, floors,
                ))
                n_keys += 1
            return _batch(out, schema)

        key, parts, held = None, [], 0
        for batch in batches:
            dims, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(labels) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(dims)]):
                while a < b:
                    here = (int(dims[a]), int(labels[a]))
                    if parts and (here != key or held >= TREE_ROWS):
                        yield flush(key, parts)
                        parts, held = [], 0
                    stop = min(b, a + TREE_ROWS - held)
                    run_of = batch.slice(a, stop - a)
                    vectors = np.asarray(run_of.column(5).flatten(), dtype=np.int64).reshape(stop - a, here[0])
                    parts.append((*(np.asarray(run_of.column(i)) for i in (2, 3)), run_of.column(4).to_numpy(zero_copy_only=False), vectors))
                    key, held, a = here, held + stop - a, stop
        if parts:
            yield flush(key, parts)

    return tidy(run)


def _visit(schema: pa.Schema, exact: bool, k: int):
    """Trees, each followed by the blocks that visit it, to (anchor, place among its windows, score, id, uid) of the first k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _numbers(np.frombuffer(row["vectors"], np.int64).reshape(-1, row["dim"]), exact)
                ids, uids = np.asarray(row["ids"], np.int64), np.asarray(row["uids"], np.int64)
                if row["kind"] == "tree":
                    low, high, *shape = (np.frombuffer(x, np.int64) for x in row["tree"])
                    boxes = (_numbers(x.reshape(-1, row["dim"]), exact) for x in (low, high))
                    here = Tree(*boxes, *shape), vectors, ids, uids
                    continue
                out = []
                for i, windows in enumerate(row["windows"]):
                    if windows:
                        asked = [(w["least"], w["most"]) for w in windows]
                        found = search(*here, vectors[i], asked, k, int(uids[i]))
                        out += [
                            (int(ids[i]), int(uids[i]), w["nth"], w["id"], w["score"], int(-s), j, u)
                            for w, f in zip(windows, found) for s, j, u in f
                        ]
                yield _batch(out, schema)

    return tidy(run)


FOUND = "anchor_id long, anchor_uid long, nth int, positive_id long, positive_score long, score long, id long, uid long"
WINDOW = "array<array<struct<nth:int,id:long,score:long,least:long,most:long>>>"


def _bound(a_low: str, a_high: str, t_low: str, t_high: str, greatest: bool) -> Column:
    """Least or greatest inner product of any two vectors of two boxes."""
    both = F.arrays_zip(a_low, a_high, t_low, t_high)
    pick = F.greatest if greatest else F.least

    def add(total, x):
        a, b, c, d = (x[n].cast("double") for n in (a_low, a_high, t_low, t_high))
        return total + pick(a * c, a * d, b * c, b * d)

    return F.aggregate(both, F.lit(0.0), add)


def _search_all(trees: DataFrame, blocks: DataFrame, same_label: bool, exact: bool, k: int) -> DataFrame:
    """The first k of every window of every anchor in each tree that its block cannot rule out.

    ``blocks`` have ``windows``, and ``least`` and ``most`` over all of them. Block and tree meet by their boxes alone, dealt out by
    the tree's number, before any vector moves.
    """
    spark = trees.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = 16
    t = trees.select(
        F.col("key").alias("tree_key"), F.col("dim").alias("t_dim"), F.col("label").alias("t_label"), F.col("low").alias("t_low"),
        F.col("high").alias("t_high"), F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"),
    )
    b = blocks.select("key", "dim", "label", F.col("low").alias("a_low"), F.col("high").alias("a_high"), "least", "most")
    b = b.withColumn("a_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    labels = F.col("label") == F.col("t_label") if same_label else F.col("label") != F.col("t_label")
    box = ("a_low", "a_high", "t_low", "t_high")
    pairs = b.join(t, (F.col("a_slot") == F.col("slot")) & (F.col("dim") == F.col("t_dim")) & labels)
    slack = float(2**20 if exact else 0)  # of sums beyond double precision
    pairs = pairs.where((_bound(*box, True) + slack >= F.col("least")) & (_bound(*box, False) - slack <= F.col("most")))
    pairs = materialise(pairs.select(F.col("key").alias("block_key"), "tree_key"), "anchor-trees")
    visits = blocks.join(pairs, F.col("key") == F.col("block_key")).select("tree_key", "kind", "dim", "ids", "uids", "vectors", "windows")
    own = trees.select(F.col("key").alias("tree_key"), "kind", "dim", "ids", "uids", "vectors", "tree")
    work = own.unionByName(visits, allowMissingColumns=True).repartition(parts, "tree_key")
    work = work.sortWithinPartitions(F.col("tree_key"), F.col("kind").desc())
    return work.mapInArrow(_visit(_arrow(FOUND), exact, k), FOUND)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """Hard negatives of (vec_id, embedding, label): for each anchor and positive the first rows of other labels in its window.

    A score is the inner product of two vectors of floor(scale * x). An anchor's positives are its first ``positives`` other rows
    of its label, its negatives the first of other labels with ``low``..``high`` percent of the positive's score; greater
    scores come first, ties by smaller id. Rows with a null id or label, a null or empty vector, or a component that is null or not
    finite take no part; vectors meet those of their own length; repeated rows are rows of their own.
    Scores beyond a long raise an error. An empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), quantised(F.col("embedding"), scale).alias("vector"),
    )
    rows = rows.where("vec_id is not null and label is not null and vector is not null").withColumn("dim", F.size("vector"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    extent = rows.select("vector").mapInArrow(_extent, EXTENT).groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    widest, largest = {}, 0
    for r in extent.collect():  # a row per coordinate
        largest = max(largest, r["dim"] * max(abs(r["low"]), abs(r["high"])) ** 2)
        widest[r["dim"]] = max(widest.get(r["dim"], (-1, 0)), (r["high"] - r["low"], r["at"]))
    if largest >= 2**63:
        raise ValueError("scores of these vectors do not fit a long")
    exact = largest >= EXACT
    first = F.lit(0).cast("long")
    for dim, (_, at) in widest.items():
        first = F.when(F.col("dim") == dim, F.element_at("vector", at + 1)).otherwise(first)
    n = max(parts, -(-rows.count() // TREE_ROWS))
    order = ["dim", "label", "slab", "uid"]
    packed = rows.withColumn("slab", first).repartitionByRange(n, *order).sortWithinPartitions(*order)
    packed = packed.select("dim", "label", "vec_id", "uid", "anchor", "vector").mapInArrow(_pack(_arrow(PACKED), exact, positives), PACKED)
    packed = materialise(packed, "trees")
    trees, blocks = packed.where("kind = 'tree'").drop("floors"), packed.where("kind = 'anchors'").drop("tree")

    any_score = F.transform("floors", lambda f: F.array(F.struct(
        F.lit(0).alias("nth"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("score"),
        f.alias("least"), F.lit(MOST).alias("most"),
    )))
    asked = blocks.withColumns(
        {"windows": any_score.cast(WINDOW), "least": F.array_min("floors"), "most": F.lit(MOST)}
    )
    found = _search_all(trees, asked, True, exact, positives)
    place = F.row_number().over(Window.partitionBy("anchor_uid").orderBy(F.col("score").desc(), "id", "uid"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    best = materialise(best.select("anchor_uid", F.col("place").alias("nth"), "id", "score"), "positives")

    # The windows of a block: at most BLOCK_ROWS anchors of ``positives`` windows each.
    window = F.struct("nth", "id", "score", F.expr(f"ceil(score * {low}BD / 100)").cast("long").alias("least"),
                      F.expr(f"floor(score * {high}BD / 100)").cast("long").alias("most"))
    per_anchor = best.groupBy("anchor_uid").agg(F.array_sort(F.collect_list(window)).alias("w"))
    placed = blocks.select("key", F.posexplode("uids").alias("at", "u")).join(per_anchor, F.col("u") == F.col("anchor_uid"), "left")
    per_block = placed.groupBy(F.col("key").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ws"),
        F.min(F.array_min(F.transform("w", lambda x: x["least"]))).alias("least"),
        F.max(F.array_max(F.transform("w", lambda x: x["most"]))).alias("most"),
    )
    asked = blocks.join(materialise(per_block, "windows"), F.col("key") == F.col("of"))
    asked = asked.withColumn("windows", F.transform("ws", lambda x: x["w"]).cast(WINDOW))
    found = _search_all(trees, asked, False, exact, negatives)
    place = F.row_number().over(Window.partitionBy("anchor_uid", "nth").orderBy(F.col("score").desc(), "id", "uid"))
    return found.withColumn("rank", place).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
