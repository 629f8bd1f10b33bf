"""Random gather against plain indexing."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import tok_frame
from corpusflow.operators import gather
from corpusflow.operators.mixing import noise_tokens
from corpusflow.operators.packing import pack_blocks
from test_plans import formatted


@pytest.mark.parametrize("slice_len", [10, 64, 1 << 20])
def test_gathered_tokens_equal_indexing(spark, slice_len):
    rng = random.Random(slice_len)
    streams = {1: [rng.randrange(1000) for _ in range(203)], 2: [rng.randrange(1000) for _ in range(8)]}
    rows = [(s, b, ids[8 * b : 8 * b + 8]) for s, ids in streams.items() for b in range(-(-len(ids) // 8))]
    blocks = spark.createDataFrame(rows, "stream long, block_id long, ids array<int>")
    asked = [(s, t, c, [rng.randrange(len(streams[s])) for _ in range(n)]) for s, t, c, n in [(1, 1, 0, 40), (1, 1, 1, 13), (2, 2, 0, 50), (1, 3, 0, 1)]]
    draws = spark.createDataFrame(asked, "stream long, target long, chunk long, positions array<long>")
    got = {}
    for r in sorted(gather.gather_tokens(blocks, draws, 8, slice_len).collect(), key=lambda r: r.nth):
        got.setdefault((r.target, r.chunk), []).extend(r.ids)
    assert got == {(t, c): [streams[s][p] for p in pos] for s, t, c, pos in asked}


def test_noise_has_no_row_per_token(spark):
    rows = [("train", "d", i, [i % 50] * 100) for i in range(100)]
    blocks = pack_blocks(tok_frame(spark, rows), 64, ["split", "domain"], ["doc_id"]).cache()
    sizes = spark.createDataFrame([("train", "d", 5000)], "split string, domain string, n long")
    noise = noise_tokens(blocks, 64, sizes, 3)
    assert "explode(sequence(cast(0 as bigint), 4999" not in formatted(noise)
    out = noise.orderBy("block_id").collect()
    assert [len(r.ids) for r in out] == [64] * 78 + [8] and [r.block_id for r in out] == list(range(79))
    again = noise_tokens(blocks.repartition(3), 64, sizes, 3).orderBy("block_id").collect()
    assert [r.ids for r in again] == [r.ids for r in out]
    assert noise_tokens(blocks, 64, sizes.withColumn("n", F.lit(0).cast("long")), 3).count() == 0
