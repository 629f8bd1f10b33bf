from pyspark.sql import functions as F

from conftest import tok_frame
from corpusflow.operators.packing import (
    concat_shard,
    context_tail,
    pack_blocks,
    shard_contiguous,
    token_offsets,
)


def _stream(rows):
    out = []
    for r in sorted(rows, key=lambda r: r[2]):
        out += r[3]
    return out


def test_pack_then_unpack_is_identity(spark):
    rows = [("train", "d", i, list(range(i * 10, i * 10 + (i * 7) % 23))) for i in range(40)]
    rows.append(("train", "d", 99, list(range(1000, 1000 + 37))))  # spans three blocks of 16
    df = tok_frame(spark, rows)
    blocks = pack_blocks(df, 16, ["split", "domain"], ["doc_id"]).collect()
    flat = []
    for b in sorted(blocks, key=lambda b: b.block_id):
        flat += b.ids
    assert flat == _stream(rows)
    sizes = [len(b.ids) for b in sorted(blocks, key=lambda b: b.block_id)]
    assert all(s == 16 for s in sizes[:-1]) and 0 < sizes[-1] <= 16


def test_offsets_tile_stream(spark):
    rows = [("val", "d", i, [1] * (i % 5)) for i in range(30)]
    out = token_offsets(tok_frame(spark, rows), ["split", "domain"], ["doc_id"]).orderBy("doc_id").collect()
    pos = 0
    for r in out:
        assert r.offset == pos
        pos += r.n_tokens
    assert all(r.stream_len == pos for r in out)


def test_shards_more_than_rows_and_sizes(spark):
    df = spark.range(3).withColumnRenamed("id", "doc_id")
    assert sorted(r.shard for r in shard_contiguous(df, 10, ["doc_id"]).collect()) == [0, 1, 2]
    df = spark.range(23).withColumnRenamed("id", "doc_id")
    sizes = dict(shard_contiguous(df, 5, ["doc_id"]).groupBy("shard").count().collect())
    assert [sizes[i] for i in range(5)] == [5, 5, 5, 4, 4]


def test_concat_shard_keeps_order(spark):
    rows = [("train", "d", i, [i]) for i in range(12)]
    sh = shard_contiguous(tok_frame(spark, rows), 3, ["doc_id"], ["split", "domain"])
    got = {r.shard: r.ids for r in concat_shard(sh, "shard", ["doc_id"], part_cols=["split", "domain"]).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9, 10, 11]}


def test_context_tail(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2],)], "ids array<int>")
    out = [r.ids for r in context_tail(df, "ids", 3).collect()]
    assert out == [[3, 4, 5], [1, 2]]


def test_ids_stats_kernel(spark):
    from corpusflow.functions.arrow import ids_stats

    df = spark.createDataFrame([([5, 0, 2],), ([],), ([7],)], "ids array<int>")
    got = [tuple(r) for r in df.select(ids_stats(F.col("ids")).alias("s")).select("s.*").collect()]
    assert got == [(3, 5, 2, 1 * 6 + 2 * 1 + 3 * 3), (0, None, None, 0), (1, 7, 7, 8)]


def test_local_cut_equals_exploded(spark):
    from corpusflow.operators.packing import pack_blocks_exploded

    rows = [("train", "d%d" % (i % 3), i, list(range(i, i + (i * 13) % 41))) for i in range(200)]
    df = tok_frame(spark, rows)
    for tpb in (50, 1000, 1 << 22):
        a = pack_blocks(df, 16, ["split", "domain"], ["doc_id"], tokens_per_bucket=tpb)
        b = pack_blocks_exploded(df, 16, ["split", "domain"], ["doc_id"])
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_packed_ids_come_back():
    import numpy as np
    import pyarrow as pa

    from corpusflow.functions.arrow import joined_ids, pack, packed_ids, unpack, unpacked_ids

    rows = [[], [1, 255], [0], [256, 65535], [], [65536, -1, 2**31 - 1]]
    lists = pa.array(rows, pa.list_(pa.int32()))
    packed = pa.concat_arrays([packed_ids.func(lists.slice(i, 1)) for i in range(len(rows))])  # a width each
    assert [len(x) for x in packed.to_pylist()] == [1, 3, 2, 5, 1, 13]
    for p in (packed, packed_ids.func(lists)):
        assert [x for part in unpacked_ids.func(iter([p.slice(1)])) for x in part.to_pylist()] == rows[1:]
    nested = pa.ListArray.from_arrays(pa.array([0, 2, 2, 6], pa.int32()), packed)
    assert [x for part in joined_ids.func(iter([nested])) for x in part.to_pylist()] == [[1, 255], [], [0, 256, 65535, 65536, -1, 2**31 - 1]]
    vals, off = unpack(pack(np.zeros(0, np.int32), np.zeros(1, np.int64)))
    assert len(vals) == 0 and off.tolist() == [0]


def test_tasks_follow_the_tokens(spark):
    from corpusflow.session import TASK_TOKENS, dealt, tasks_for

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, None) == tasks_for(spark, TASK_TOKENS) == n and tasks_for(spark, 100 * TASK_TOKENS + 1) == 101
    df = spark.range(10)
    assert dealt(df, n, "id") is df and dealt(df, n + 1, "id").rdd.getNumPartitions() == n + 1


def test_pack_blocks_in_more_tasks_than_partitions(spark, monkeypatch):
    from corpusflow import session

    rows = [("train", d, i, [(i * 31 + j) % 300 for j in range(i % 90)]) for d in ("a", None) for i in range(120)]
    want = pack_blocks(tok_frame(spark, rows), 16, ["split", "domain"], ["doc_id"], tokens_per_bucket=100).collect()
    monkeypatch.setattr(session, "TASK_TOKENS", 500)
    got = pack_blocks(tok_frame(spark, rows), 16, ["split", "domain"], ["doc_id"], tokens_per_bucket=100)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
