"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; a pair of codes is a cell of the product grid.
Every vector visits the cells nearest to it in the order of the sum of its squared distances to the two
codes (the multi-sequence order), as many as a sample of queries, compared with all rows, needs for
the target recall. Where too few queries have links to tell, the sample gets partners made for it, at the
threshold itself, and these set the visits. What a vector finds there is verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.graph import components, merge
from corpusflow.session import materialise

THRESHOLD = 0.9
TARGET_RECALL = 0.999
FIT_ROWS = 20_000  # vectors that the codebooks are fitted on, at most
QUERY_ROWS = 512  # vectors whose links are searched in all rows to set the number of visits, at first
MAX_QUERY_ROWS = 32_768  # and in all, where few of them have links
QUERY_BLOCK = 512  # queries compared at a time
ENOUGH = 64  # groups of queries with links, from which the visits are set
CELL_ROWS = 64  # wanted mean rows of a cell
MAX_CODES = 2048  # of a half, which is four million cells; codes grow with the root of the rows up to there
MEMBERS, PROBES = 256, 512  # rows of a cell that meet in a task
ROUNDS = 12
WHOLE_CELL_ROWS = 4096  # wanted mean rows of a cell, and rows that meet, where made partners set the visits
MADE_QUERIES = 4096  # vectors that partners are made for
BLOCK_CELLS = 2_000_000  # distances held at a time


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that can link: no null, zero or non-finite ones; v has unit length in double.

    ``dim`` is its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, dims = [], [], []
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero((sizes == size) & np.asarray(column.is_valid()))
                part = column.take(pa.array(at))
                x = np.asarray(part.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(at), size)
                fine = np.isfinite(x).all(axis=1)
                scale = np.abs(np.where(fine[:, None], x, 0)).max(axis=1)
                good = fine & (scale > 0)
                y = x[good] / scale[good][:, None]
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                ids += batch.column(0).take(pa.array(at[good])).to_pylist()
                out += list(y)
                dims += [size] * len(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64())), pa.array(dims, pa.int32())],
                names=["id", "v", "dim"],
            )

    return rows.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "id long, v array<double>, dim int")


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves; at most ``MAX_CODES`` rows each."""

    left: np.ndarray
    right: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        square = lambda a, c: np.maximum(
            (a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)[None, :], 0
        )
        return square(x[:, :h], self.left), square(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of every row, nearest first.

        The pair of the i-th and j-th nearest codes has (i+1)(j+1) - 1 pairs before it, so only pairs
        with (i+1)(j+1) <= n can be among the first n.
        """
        n = min(n, len(self.left) * len(self.right))
        most = [min(n, len(self.left)), min(n, len(self.right))]
        pairs = [(i, j) for i in range(most[0]) for j in range(min(most[1], n // (i + 1)))]
        i, j = (np.array(p) for p in zip(*pairs))
        step = max(1, BLOCK_CELLS // max(len(pairs), len(self.left), len(self.right)))
        out = np.empty((len(x), n), dtype=np.int64)
        for at in range(0, len(x), step):
            a, b = self.distances(x[at : at + step])
            ia, ib = np.argsort(a, axis=1)[:, : most[0]], np.argsort(b, axis=1)[:, : most[1]]
            da, db = np.take_along_axis(a, ia, axis=1), np.take_along_axis(b, ib, axis=1)
            nearest = np.argsort(da[:, i] + db[:, j], axis=1, kind="stable")[:, :n]
            left, right = np.take_along_axis(ia, i[nearest], axis=1), np.take_along_axis(ib, j[nearest], axis=1)
            out[at : at + step] = left * len(self.right) + right
        return out

    def places(self, x: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """At which visit (from 0) every row comes to the cell of its partner."""
        cells = self.cells(partners)
        step = max(1, BLOCK_CELLS // (len(self.left) * len(self.right)))
        out = np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), step):
            a, b = self.distances(x[at : at + step])
            sums = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
            own = np.take_along_axis(sums, cells[at : at + step, None], axis=1)
            out[at : at + step] = (sums <= own).sum(axis=1) - 1
        return out


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced rows of a hash-ordered sample."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    step = max(1, BLOCK_CELLS // k)
    for _ in range(ROUNDS):
        square = (codes * codes).sum(axis=1)[None, :]
        blocks = range(0, len(x), step)
        near = np.concatenate([(square - 2 * x[at : at + step] @ codes.T).argmin(axis=1) for at in blocks])
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        codes[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return codes


def _least_hashed(vectors: DataFrame, salt: str, limit: int, rows: int) -> pa.Table:
    """The ``limit`` of ``rows`` vectors with the least hash of salt and id.

    Only vectors with a hash small enough for four times the limit are sorted, however many there are.
    """
    h = F.xxhash64(F.lit(salt), F.col("id"))
    near = vectors.select("id", "v").where(F.pmod(h, F.lit(1 << 40)) * float(rows) <= 4.0 * limit * (1 << 40))
    return near.orderBy(F.pmod(h, F.lit(1 << 40)), "id").limit(limit).toArrow()


def fit_index(vectors: DataFrame, rows: int, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS) -> MultiIndex:
    """Codebooks from at most ``fit_rows`` vectors, those of least hash of the id, of ``rows`` in all."""
    sample = _least_hashed(vectors, "fit", fit_rows, rows)
    x = _matrix(sample["v"].combine_chunks())
    k = int(np.clip(round((rows / cell_rows) ** 0.5), 1, min(MAX_CODES, max(1, len(x) // 10))))
    h = max(1, x.shape[1] // 2)
    return MultiIndex(_codebook(x[:, :h], k), _codebook(x[:, h:], k))


def _places(vectors: DataFrame, queries: np.ndarray, names: np.ndarray, index: MultiIndex, threshold: float) -> DataFrame:
    """(query, place, n): links of each query to the rows of the cell that it visits at that place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = index.distances(queries)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1)), np.asarray(batch.column(0))
            cells = index.cells(x)
            for at in range(0, len(queries), QUERY_BLOCK):
                some = slice(at, at + QUERY_BLOCK)
                q, r = np.nonzero((queries[some] @ x.T >= threshold) & (names[some, None] != ids[None, :]))
                key, n = np.unique((q + at) * (a.shape[1] * b.shape[1]) + cells[r], return_counts=True)
                q, cell = np.divmod(key, a.shape[1] * b.shape[1])
                place = np.empty(len(key), dtype=np.int64)
                for one in np.unique(q):
                    mine = q == one
                    sums = (a[one][:, None] + b[one][None, :]).ravel()
                    place[mine] = (sums <= sums[cell[mine]][:, None]).sum(axis=1) - 1
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(place), pa.array(n)], names=["query", "place", "n"])

    found = vectors.select("id", "v").mapInArrow(run, "query long, place long, n long")
    return found.groupBy("query", "place").agg(F.sum("n").alias("n"))


def _query_groups(x: np.ndarray, threshold: float) -> np.ndarray:
    """Group of every query: the first query, itself in no earlier group, that it links with."""
    groups = np.full(len(x), -1)
    for i in range(len(x)):
        if groups[i] < 0:
            groups[(groups < 0) & (x @ x[i] >= threshold)] = i
            groups[i] = i
    return groups


def visits_needed(
    vectors: DataFrame, rows: int, index: MultiIndex, threshold: float, target: float, query_rows: int = QUERY_ROWS
) -> tuple[int | None, float | None]:
    """(visits per vector, recall measured with them): links of sampled queries, searched in all rows.

    Recall is that of a query, whatever the number of its links, and queries that link with each other
    share the weight of one, so that a large group does not set the visits alone. Queries are drawn until
    ``ENOUGH`` groups of them have links, or all vectors are queries. If ``MAX_QUERY_ROWS`` queries do
    not have them, the visits cannot be told: (None, None).
    The driver gets a row per query with links, and as many as there are cells.
    """
    drawn, parts = 0, []
    while True:
        limit = min(rows, MAX_QUERY_ROWS, max(query_rows, 4 * drawn))
        sample = _least_hashed(vectors, "query", limit, rows).slice(drawn)
        if sample.num_rows:
            queries, names = _matrix(sample["v"].combine_chunks()), np.asarray(sample["id"])
            found = materialise(_places(vectors, queries, names, index, threshold), "vector-queries")
            totals = found.groupBy("query").agg(F.sum("n").alias("total")).toArrow()
            parts.append((found, np.asarray(totals["query"]), np.asarray(totals["total"]), queries))
        drawn = limit
        linked = [queries[q] for _, q, _, queries in parts]
        groups = _query_groups(np.concatenate(linked), threshold) if linked else np.zeros(0, int)
        n_groups = len(np.unique(groups))
        if n_groups >= ENOUGH or drawn >= rows:
            break
        if drawn >= MAX_QUERY_ROWS:
            return None, None
    if not n_groups:  # every vector was a query: there are no links
        return 1, 1.0
    shares = 1 / np.bincount(groups)[groups]
    weights, at = {}, 0
    for found, q, totals, _ in parts:
        share = pa.table({"_query": q, "share": shares[at : at + len(q)] / totals})
        at += len(q)
        share = F.broadcast(vectors.sparkSession.createDataFrame(share))
        by = found.join(share, F.col("query") == F.col("_query")).groupBy("place").agg(F.sum(F.col("n") * F.col("share")).alias("w"))
        for r in by.collect():
            weights[r["place"]] = weights.get(r["place"], 0.0) + r["w"]
    places = sorted(weights.items())
    need, seen = 1, 0.0
    for place, w in places:
        seen += w
        need = place + 1
        if seen >= target * n_groups:
            break
    need = int(np.ceil(1.5 * need)) + 2  # a margin for what the sample does not show
    reached = sum(w for place, w in places if place < need)
    return need, min(1.0, reached / n_groups)


def made_partners(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Two partners of every unit row at just the ``threshold``: towards no row in particular, and towards another row."""
    rng = np.random.default_rng(len(x))
    out = []
    for towards in (rng.normal(size=x.shape), np.roll(x, 1, axis=0) + 1e-6 * rng.normal(size=x.shape)):
        aside = towards - (towards * x).sum(axis=1)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
        out.append(threshold * x + np.sqrt(1 - threshold**2) * aside)
    return out[0], out[1]


def visits_of_made(vectors: DataFrame, rows: int, index: MultiIndex, threshold: float, target: float) -> tuple[int, float]:
    """(visits per vector, recall with them) for partners made at the threshold, the less found kind of the two."""
    x = _matrix(_least_hashed(vectors, "made", min(rows, MADE_QUERIES), rows)["v"].combine_chunks())
    found = [np.sort(index.places(x, partners)) for partners in made_partners(x, threshold)]
    need = max(int(p[min(len(p) - 1, int(np.ceil(target * len(p))))]) for p in found) + 1
    return need, min(float((p < need).mean()) for p in found)


def _visited(vectors: DataFrame, index: MultiIndex, visits: int) -> DataFrame:
    """``vectors`` with ``near``: the cells that each visits, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = index.visits(_matrix(batch.column(1)), visits)
                at = pa.array((np.arange(len(near) + 1) * near.shape[1]).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "copies", "near"])

    return vectors.select("id", "v", "copies").mapInArrow(run, "id long, v array<double>, copies long, near array<long>")


def _dealt(visited: DataFrame) -> DataFrame:
    """A member row of each vector in its cell and a probe row in every cell that it visits."""
    own = F.element_at("near", 1)
    members = visited.select(own.alias("cell"), F.lit(0).alias("probe"), "id", "v", "copies", "near")
    probes = visited.select(F.explode("near").alias("cell"), F.lit(1).alias("probe"), "id", "v", "copies", F.array(own).alias("near"))
    return members.union(probes)


def _spread(rows: DataFrame, in_block: tuple[int, int]) -> DataFrame:
    """Cells with many rows as blocks of members x blocks of probes, so that a task's share is bounded."""
    sizes = rows.groupBy("cell").agg(
        F.sum((F.col("probe") == 0).cast("long")).alias("members"), F.sum("probe").alias("probes")
    )
    sizes = materialise(
        sizes.select(
            F.col("cell").alias("_cell"),
            F.ceil(F.col("members") / in_block[0]).alias("_m"),
            F.ceil(F.col("probes") / in_block[1]).alias("_p"),
        ).where("_m > 0"),
        "cells",
    )
    rows = rows.join(sizes, F.col("cell") == F.col("_cell"))
    member = F.col("probe") == 0
    own = F.pmod(F.xxhash64("id"), F.when(member, F.col("_m")).otherwise(F.col("_p")))
    others = F.sequence(F.lit(0).cast("long"), F.when(member, F.col("_p")).otherwise(F.col("_m")) - 1)
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(others))
    return rows.select(
        "cell",
        F.when(member, F.col("_own")).otherwise(F.col("_other")).alias("i"),
        F.when(member, F.col("_other")).otherwise(F.col("_own")).alias("j"),
        "probe", "id", "v", "copies", "near",
    )


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each block: (a, b, null) edges and (a, null, n) additions to a's number of links."""
    key, members = None, None

    def compare(members, probes):
        (ids, x, copies, near), (qids, q, qcopies, qcell) = members, probes
        at, mt = np.nonzero(q @ x.T >= threshold)
        fine = qids[at] != ids[mt]
        at, mt = at[fine], mt[fine]
        # Found from the other side as well: counted only where the smaller id probes.
        twice = (near[mt] == qcell[at][:, None]).any(axis=1)
        fine = ~twice | (qids[at] < ids[mt])
        at, mt = at[fine], mt[fine]
        if not len(at):
            return None
        ends = np.concatenate([qids[at], ids[mt]])
        adds = np.concatenate([copies[mt], qcopies[at]])
        who, place = np.unique(ends, return_inverse=True)
        sums = np.bincount(place, weights=adds).astype(np.int64)
        edges = _forest(qids[at], ids[mt])
        n, m = len(who), len(edges[0])
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(who), pa.array(edges[0])]),
                pa.concat_arrays([none(n), pa.array(edges[1])]),
                pa.concat_arrays([pa.array(sums), none(m)]),
            ],
            names=["a", "b", "n"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in range(4)]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            near = part.column(7)
            rows = (
                np.asarray(part.column(4)),
                _matrix(part.column(5)),
                np.asarray(part.column(6)),
                np.asarray(near.flatten()).reshape(len(near), -1),
            )
            block = tuple(int(c[a]) for c in cols[:3])
            if cols[3][a] == 0:
                if key == block and members is not None:
                    members = tuple(np.concatenate([x, y]) for x, y in zip(members, rows))
                else:
                    members = rows
                key = block
            elif key == block:
                out = compare(members, (*rows[:3], rows[3][:, 0]))
                if out is not None:
                    yield out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (a, b) connect, one per node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = np.arange(len(nodes))
    merge(labels, at[: len(a)], at[len(a) :])
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[child], nodes[labels[child]]


def _links(reps: DataFrame, n: int, threshold: float, target_recall: float, report: dict | None) -> DataFrame:
    """(a, b, n) of ``_verify`` for ``n`` different vectors of one length."""
    index = fit_index(reps, n)
    visits, recall = visits_needed(reps, n, index, threshold, target_recall)
    in_block = MEMBERS, PROBES
    if visits is None:
        # Links are rare: fewer, larger cells, so that a vector is not copied into hundreds of them.
        index, in_block = fit_index(reps, n, cell_rows=WHOLE_CELL_ROWS), (WHOLE_CELL_ROWS, WHOLE_CELL_ROWS)
        visits, recall = visits_of_made(reps, n, index, threshold, target_recall)
    if report is not None:
        report |= {"visits": visits, "recall": recall, "codes": len(index.left)}
    visited = materialise(_visited(reps, index, visits), "vector-visits")
    blocks = _spread(_dealt(visited), in_block)
    blocks = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "probe")
    return materialise(blocks.mapInArrow(lambda b: _verify(b, threshold), "a long, b long, n long"), "vector-links")


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    report: dict | None = None,
) -> DataFrame:
    """A row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link at a cosine of ``threshold`` or more. Equal vectors are looked up once and linked with
    each other. Null, zero and non-finite vectors link with nothing and stand alone. Ids should be
    unique (of repeated ids, all rows get the most links and the least component); rows with a null id stand
    alone with null component. Vectors of different lengths do not link; every length has an index of its
    own, one after the other; so does the number of codes, which grows with the root of the vectors. A vector of any
    length is held whole. ``report`` gets the visits per vector and the recall that the sample of
    queries (or of made partners, where links are rare) measured for the most frequent length.
    """
    spark = rows.sparkSession
    ids = materialise(usable_vectors(rows.where(F.col(id_col).isNotNull()), id_col, vector_col), "vectors")
    groups = ids.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups, "vector-groups")
    reps = groups.select(F.col("rep").alias("id"), "v", "copies")
    lengths = reps.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()
    found = spark.createDataFrame([], "a long, b long, n long")
    for place, row in enumerate(lengths):
        if row["count"] > 1:
            own = report if place == 0 else None
            found = found.union(_links(reps.where(F.size("v") == row["dim"]), row["count"], threshold, target_recall, own))
    linked = found.where("n IS NOT NULL").groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_n"))
    comps = materialise(components(found.where("b IS NOT NULL").select("a", "b")), "vector-components")
    comps = comps.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    # Ids of groups of equal vectors are their least, so the least id of a component is among them.
    labels = groups.join(linked, F.col("rep") == F.col("_rep"), "left").join(comps, F.col("rep") == F.col("_node"), "left")
    labels = materialise(
        labels.select(
            F.col("v").alias("_v"),
            (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("_root", "rep").alias("component_id"),
        ),
        "vector-labels",
    )
    known = ids.join(labels, F.col("v") == F.col("_v")).select(F.col("id").alias("_id"), "n_links", "component_id")
    known = known.groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    known = materialise(known, "vector-known")
    out = rows.select(F.col(id_col)).join(known, F.col(id_col) == F.col("_id"), "left")
    return out.select(
        id_col,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", id_col).cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
