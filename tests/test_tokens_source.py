"""The token data source: reads by position, commits whole versions only."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import tok_frame
from corpusflow.operators.packing import pack_blocks
from corpusflow.sources.tokens import (
    EqualTo,
    GreaterThanOrEqual,
    LessThanOrEqual,
    TokenReader,
    read_manifest,
    read_token_stream,
    write_token_stream,
)

L = 8


@pytest.fixture()
def blocks(spark):
    rows = [("train", d, i, [(i * 31 + j) % 60000 for j in range(50 + i % 7)]) for d in ("a", "b/c", None) for i in range(30)]
    return pack_blocks(tok_frame(spark, rows), L, ["split", "domain"], ["doc_id"])


def flat(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        out.setdefault((r.split, r.domain), []).extend(r.ids)
    return out


def stream(blocks):
    return flat(blocks.select("split", "domain", F.col("block_id").alias("pos"), "ids"))


def test_round_trip_and_pieces(spark, tmp_dir, blocks):
    manifest = write_token_stream(blocks, f"{tmp_dir}/t", L, blocks_per_file=4)
    want = stream(blocks)
    for piece in (3, 8, 20, 1 << 16):
        got = read_token_stream(spark, f"{tmp_dir}/t", piece)
        assert flat(got) == want and got.agg(F.max("n_tokens")).first()[0] <= piece
    assert manifest.agg(F.sum("n_tokens")).first()[0] == sum(map(len, want.values()))
    assert manifest.where(f"n_tokens > {4 * L}").isEmpty()


def test_a_slice_reads_its_bytes_only(spark, tmp_dir, blocks):
    root = f"{tmp_dir}/t"
    manifest = write_token_stream(blocks, root, L, blocks_per_file=4)
    want = stream(blocks)["train", "a"]
    reader = TokenReader({"path": root, "piece_len": "16"})
    list(reader.pushFilters([EqualTo(("domain",), "a"), GreaterThanOrEqual(("pos",), 160), LessThanOrEqual(("pos",), 191)]))
    assert sum(p.n for p in reader.partitions()) == 32
    for r in manifest.where("domain is null or domain != 'a' or first_pos not in (160)").collect():
        os.remove(r.file)  # nothing else is opened
    df = read_token_stream(spark, root, 16).where("split = 'train' and domain = 'a' and pos between 160 and 191")
    assert flat(df) == {("train", "a"): want[160:192]}
    assert read_token_stream(spark, root, 16).where("domain = 'none'").collect() == []


def test_a_failed_job_leaves_nothing_and_a_rerun_nothing_stale(spark, tmp_dir, blocks):
    root = f"{tmp_dir}/t"
    bad = blocks.withColumn("ids", F.when(F.col("block_id") == 20, F.array(F.lit(70000))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="uint16"):
        write_token_stream(bad, root, L, blocks_per_file=4)
    assert read_token_stream(spark, root).count() == 0
    write_token_stream(blocks, root, L, blocks_per_file=4)  # tasks that outlived the failure may have left files
    before, want = files(root), stream(blocks)
    assert before == {os.path.join(root, f) for f in read_manifest(root)["file"].to_pylist()}
    with pytest.raises(Exception, match="uint16"):
        write_token_stream(bad, root, L, blocks_per_file=4)
    assert files(root) >= before and flat(read_token_stream(spark, root)) == want
    write_token_stream(blocks.where("domain = 'a'"), root, L, blocks_per_file=2)
    assert files(root) == {os.path.join(root, f) for f in read_manifest(root)["file"].to_pylist()}
    assert not files(root) & before and flat(read_token_stream(spark, root)) == {("train", "a"): want["train", "a"]}
    write_token_stream(blocks.where("domain = 'b/c'"), root, L, append=True)
    assert flat(read_token_stream(spark, root)) == {k: want[k] for k in (("train", "a"), ("train", "b/c"))}
    with pytest.raises(Exception, match="two files hold"):
        write_token_stream(blocks.where("domain = 'a'"), root, L, append=True)
    assert len(flat(read_token_stream(spark, root))) == 2


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".bin")}


def test_nothing_to_write_or_read(spark, tmp_dir, blocks):
    assert write_token_stream(blocks.limit(0), f"{tmp_dir}/e", L).count() == 0
    assert read_token_stream(spark, f"{tmp_dir}/e").count() == 0


def test_small_files_share_a_task(spark, tmp_dir, blocks):
    root = f"{tmp_dir}/t"
    manifest = write_token_stream(blocks, root, L, blocks_per_file=2)
    assert manifest.count() > 100 and len(TokenReader({"path": root}).partitions()) == 1
    assert flat(read_token_stream(spark, root)) == stream(blocks)
