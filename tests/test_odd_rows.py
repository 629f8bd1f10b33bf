"""Rows of a null domain, null or repeated ids and hot keys: none is lost, and every count is exact."""

import math

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.mixing import (
    carve_tail,
    concat_domains,
    concat_streams,
    mix_by_rate,
    noise_tokens,
    resample_spans,
    shuffle_blocks,
)
from corpusflow.operators.packing import concat_shard, pack_blocks, shard_contiguous, token_offsets
from corpusflow.operators.splits import (
    split_fraction,
    split_nested_halves,
    split_prefix,
    split_round_robin,
    split_shuffled,
)
from corpusflow.plans.index import ordered_index, range_buckets
from test_plans import formatted

N = 1000


@pytest.fixture(scope="module")
def odd(spark):
    """Half of the rows have no domain, a fifth no id, and id 7 stands 100 times."""
    rows = [(None if i % 2 else "d", None if i % 5 == 0 else 7 if i % 10 == 1 else i, f"text {i}" + "x" * (i % 9), [i, i + 1]) for i in range(N)]
    df = spark.createDataFrame(rows, "domain string, doc_id long, text string, ids array<int>").repartition(7)
    return df.withColumn("split", F.lit("train")).withColumn("n_tokens", F.size("ids").cast("long"))


def counts(df, *cols):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*cols).count().collect()}


def test_ordered_operators_keep_null_domains(odd):
    part = ["split", "domain"]
    located = token_offsets(odd, part, ["doc_id"])
    assert counts(located, "domain") == {(None,): 500, ("d",): 500}
    for r in located.groupBy("domain").agg(F.count_distinct("offset").alias("n"), F.max("offset").alias("m"), F.max("stream_len").alias("t")).collect():
        assert (r.n, r.m, r.t) == (500, 998, 1000)
    assert counts(split_round_robin(odd, ["doc_id"], ["domain"]), "domain", "split") == {
        (d, s): n for d in (None, "d") for s, n in (("train", 350), ("val", 100), ("test", 50))
    }
    sharded = shard_contiguous(odd, 8, ["doc_id"], part)
    assert sorted(counts(sharded, "domain", "shard").values()) == [62] * 8 + [63] * 8
    for packed in (pack_blocks(odd, 16, part, ["doc_id"]), concat_shard(sharded, "shard", ["doc_id"], 16, part)):
        assert packed.select(F.sum(F.size("ids"))).first()[0] == 2 * N
    assert concat_domains(odd, 16).select(F.sum(F.size("ids"))).first()[0] == 2 * N


def test_splits_are_exact(odd):
    half = math.ceil(0.05 * 500)
    by_domain = {(d, s): n for d in (None, "d") for s, n in (("train", 500 - half), ("val", half))}
    assert counts(split_shuffled(odd.drop("split"), "doc_id", 0.05, part_cols=["domain"]), "domain", "split") == by_domain
    assert counts(split_shuffled(odd.drop("split"), "doc_id", 0.05), "split") == {("train",): 950, ("val",): 50}
    assert counts(split_fraction(odd.drop("split"), "doc_id", 0.3), "split") == {("train",): 300, ("val",): 700}
    nested = counts(split_nested_halves(odd.drop("split"), "doc_id", 0.05, part_cols=["domain"]), "domain", "split")
    rest = 500 - half
    assert nested == {(d, s): n for d in (None, "d") for s, n in (("val", half), ("train2", math.ceil(rest / 2)), ("train1", rest // 2))}


def test_one_repeated_id_is_cut_exactly(spark):
    df = spark.createDataFrame([(1, "a", i) for i in range(100)], "id long, g string, nth int").repartition(4)
    for share, n in ((0.0, 0), (0.13, 13), (1.0, 100)):
        got = split_shuffled(df, "id", share, part_cols=["g"])
        assert counts(got, "split").get(("val",), 0) == n and got.select("nth").distinct().count() == 100


def test_prefix_split_keeps_every_character(odd):
    df = odd.drop("split")
    want = df.groupBy("domain").agg(F.sum(F.length("text")).alias("n")).collect()
    got = counts_of_chars(split_prefix(df, "text", ["doc_id", "text"], 0.8, ["domain"]))
    for r in want:
        assert got[(r.domain, "train")] == int(0.8 * r.n) and got[(r.domain, "val")] == r.n - int(0.8 * r.n)
    whole = counts_of_chars(split_prefix(df, "text", ["doc_id", "text"], 1.0, ["domain"]))
    assert {k for k in whole} == {(None, "train"), ("d", "train")}


def counts_of_chars(df):
    return {(r.domain, r.split): r.n for r in df.groupBy("domain", "split").agg(F.sum(F.length("text")).alias("n")).collect()}


def test_streams_without_a_domain_name(odd):
    blocks = pack_blocks(odd, 16, ["split", "domain"], ["doc_id"]).cache()

    def tokens(df):
        return df.select(F.sum(F.size("ids"))).first()[0] or 0

    assert tokens(concat_streams(blocks, 16)) == 2 * N
    carved = carve_tail(blocks, 16, 4)
    assert tokens(carved) == 2 * N and tokens(carved.where("domain = 'mix'")) == 2 * 64
    shuffled = shuffle_blocks(blocks, 16, 3)
    assert tokens(shuffled) == 2 * N
    flat = lambda df: sorted(x for r in df.select("ids").collect() for x in r.ids)
    assert flat(shuffled) == flat(blocks)
    sizes = blocks.select("split", "domain").distinct().withColumn("n", F.lit(200).cast("long"))
    assert tokens(noise_tokens(blocks, 16, sizes.where("domain is null"), 5)) == 200
    assert tokens(resample_spans(blocks, 16, sizes, 10, 5)) == 400
    assert tokens(mix_by_rate(blocks, 16, sizes.select("split", "n").distinct(), None, 10, 5)) == 200


def test_a_hot_key_spreads(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    sizes = [r["count"] for r in range_buckets(df, [], ["k"]).groupBy("_bkt").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8
    got = ordered_index(df, ["k"], weight="id")
    assert got.agg(F.count_distinct("_idx"), F.max("_idx")).first()[:] == (30_000, 29_999)
    assert got.agg(F.max(F.col("_start") + F.col("id"))).first()[0] == 30_000 * 29_999 // 2


def test_rows_cross_one_shuffle(spark, odd):
    plan = formatted(token_offsets(odd.select("split", "domain", "doc_id", "n_tokens"), ["split", "domain"], ["doc_id"]))
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    prefix = formatted(split_prefix(odd.drop("split"), "text", ["doc_id", "text"], 0.8, ["domain"]))
    assert "Exchange hashpartitioning" not in prefix and "rangepartitioning" not in prefix
