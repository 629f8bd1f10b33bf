"""Random access to a block store: only the files that a batch touches are opened."""

import pytest
from pyspark.sql import functions as F

from conftest import tok_frame
from corpusflow.operators.mixing import stream_lengths
from corpusflow.operators.packing import pack_blocks
from corpusflow.operators.sampling import draw_domains, sample_domains_weighted, sample_windows
from corpusflow.sources.blockstore import BlockStore, block_store_once, write_block_store
from test_plans import formatted

L = 8


@pytest.fixture(scope="module")
def table(spark):
    rows = [("train", f"d{i % 4}" if i % 4 else None, i, [(i * 7 + j) % 1000 for j in range(31 + i % 17)]) for i in range(400)]
    return pack_blocks(tok_frame(spark, rows), L, ["split", "domain"], ["doc_id"]).cache()


@pytest.fixture(scope="module")
def store(spark, table, tmp_path_factory):
    return write_block_store(table, str(tmp_path_factory.mktemp("store") / "s"), L, blocks_per_file=8)


def test_store_holds_the_table(table, store):
    key = lambda r: (r.split, r.domain or "", r.block_id)
    assert sorted(map(tuple, store.blocks().collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    got = sorted(map(tuple, stream_lengths(store).collect()), key=repr)
    assert got == sorted(map(tuple, stream_lengths(table).collect()), key=repr)
    files = store.index().groupBy("file").agg(F.sum("n_blocks").alias("n")).collect()
    assert len(files) >= 200 and max(r.n for r in files) <= 8 and key


def test_a_batch_opens_two_files_a_window_at_most(table, store):
    opened = []
    plain = BlockStore.files_of
    for sample in (
        lambda b: sample_domains_weighted(b, L, 5, 64, 3),
        lambda b: sample_windows(b, L, 5, 16, 9),
    ):
        got = sample(store)
        want = sample(table)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        files = {f for f in got.inputFiles() if "/blocks/" in f}
        opened.append(len(files))
        assert len(files) <= 64 * 2 and len(files) < store.index().select("file").distinct().count()
    assert plain is BlockStore.files_of and min(opened) > 1


def test_draws_read_no_block(store):
    plan = formatted(draw_domains(store, 5, 64, 3))
    assert "/blocks" not in plan and "ids" not in plan


def test_spans_across_files_and_none(spark, table, store):
    spans = spark.createDataFrame([("train", None, 0, 8 * L + 1), ("train", "d1", 8 * L, 1), ("x", "d1", 0, 5)], "split string, domain string, start long, length long")
    blocks = store.covering(spans)
    assert blocks.where("domain is null and block_id <= 8").count() == 9
    assert store.covering(spans.where("split = 'x'")).count() == 0


def test_an_incomplete_store_is_built_again(spark, table, tmp_path):
    path = str(tmp_path / "s")
    table.limit(3).write.parquet(f"{path}/blocks")
    built = []
    for _ in range(2):
        store = block_store_once(lambda: built.append(1) or table, path, spark, L)
    assert built == [1] and store.blocks().count() == table.count()


def test_a_store_written_in_order_holds_and_gives_the_same(spark, table, store, tmp_path):
    there = write_block_store(table, str(tmp_path / "s"), L, blocks_per_file=8, in_order=True)
    for a, b in ((there.blocks(), store.blocks()), (there.lengths(), store.lengths()), (sample_windows(there, L, 5, 16, 9), sample_windows(store, L, 5, 16, 9))):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
