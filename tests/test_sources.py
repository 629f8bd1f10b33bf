import io
import os
import zipfile

import numpy as np
import pytest

from conftest import tok_frame
from corpusflow.operators.mixing import rebase
from corpusflow.operators.packing import pack_blocks
from corpusflow.sources.readers import read_archives, read_jsonl_corpus, read_token_bin, read_year_partitions
from corpusflow.sources.sinks import materialise_once, write_token_bin


def test_year_partitions(spark, tmp_dir):
    df = spark.createDataFrame([(y, i) for i, y in enumerate(range(1990, 2006))], "year int, k long")
    df.write.partitionBy("year").parquet(f"{tmp_dir}/p")
    with pytest.raises(ValueError):
        read_year_partitions(spark, f"{tmp_dir}/p", [1991])
    sel = read_year_partitions(spark, f"{tmp_dir}/p", [2001, 1995])
    rows = {r.year: r.year_order for r in sel.collect()}
    assert rows == {2001: 0, 1995: 1}
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert read_year_partitions(spark, f"{tmp_dir}/p").count() == 12


def test_token_bin_roundtrip(spark, tmp_dir):
    ids = list(range(60000, 60000 + 50))
    rows = [("train", "a", 0, ids[:20]), ("train", "a", 1, ids[20:])]
    blocks = pack_blocks(tok_frame(spark, rows), 8, ["split", "domain"], ["doc_id"])
    manifest = write_token_bin(blocks, f"{tmp_dir}/bin", 8, blocks_per_file=2).collect()
    assert sum(m.n_tokens for m in manifest) == 50
    raw = np.fromfile(sorted(m.file for m in manifest)[0], dtype="<u2")
    assert raw.tolist() == ids[:16]
    back = rebase(read_token_bin(spark, f"{tmp_dir}/bin/*/*/*.bin", piece_len=5), 8, ["split", "domain"])
    flat = []
    for b in sorted(back.collect(), key=lambda b: b.block_id):
        flat += b.ids
    assert flat == ids


def test_token_bin_rejects_large_ids(spark, tmp_dir):
    blocks = pack_blocks(tok_frame(spark, [("train", "a", 0, [70000])]), 8, ["split", "domain"], ["doc_id"])
    with pytest.raises(Exception):
        write_token_bin(blocks, f"{tmp_dir}/bad", 8).collect()


def test_zip_archives(spark, tmp_dir):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("a/x.txt", "hello")
        zf.writestr("b.txt", "world")
    with open(os.path.join(tmp_dir, "one.zip"), "wb") as fh:
        fh.write(buf.getvalue())
    got = {r.member: r.content for r in read_archives(spark, f"{tmp_dir}/*.zip").collect()}
    assert got == {"a/x.txt": "hello", "b.txt": "world"}


def test_materialise_once_rebuilds_partial(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    os.makedirs(path)  # a half-written folder without _SUCCESS
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert materialise_once(build, path, spark).count() == 3
    assert materialise_once(build, path, spark).count() == 3
    assert len(calls) == 1


def test_archives_are_read_in_bounded_memory(tmp_dir, monkeypatch):
    """The peak follows a batch of members, not the archive; the members of a zip are cut into runs."""
    import tarfile
    import tracemalloc

    import pyarrow as pa

    from corpusflow.sources import readers

    data = os.urandom(250_000).hex().encode()
    tar, zipped = os.path.join(tmp_dir, "a.tar.gz"), os.path.join(tmp_dir, "a.zip")
    with tarfile.open(tar, "w:gz") as tf, zipfile.ZipFile(zipped, "w") as zf:
        for i in range(200):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
            zf.writestr(f"{i}.txt", data)
    monkeypatch.setattr(readers, "PART_BYTES", 10_000_000)
    monkeypatch.setattr(readers, "BATCH_BYTES", 2_000_000)
    batch = pa.RecordBatch.from_arrays([pa.array([tar, zipped])], names=["path"])
    parts = list(readers._parts(iter([batch])))
    assert parts[0].num_rows == 1 + 10
    tracemalloc.start()
    names = [m for b in readers._unpack(iter(parts)) for m in b.column("member").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(names) == sorted([f"{i}.txt" for i in range(200)] * 2) and peak < 15_000_000


def test_jsonl_domains_in_one_scan(spark, tmp_dir):
    for name, ids in (("a", [1, 2]), ("a b", [3]), ("c+d", [4])):
        spark.createDataFrame([(i, "x") for i in ids], "id long, text string").write.json(f"{tmp_dir}/one-scan/{name}")
    paths = {"first": f"{tmp_dir}/one-scan/a", "second": f"{tmp_dir}/one-scan/a b", "third": f"{tmp_dir}/one-scan/c+d"}
    corpus = read_jsonl_corpus(spark, paths, "id long, text string", keep=["id"])
    assert sorted((r.id, r.domain) for r in corpus.collect()) == [(1, "first"), (2, "first"), (3, "second"), (4, "third")]
    assert corpus._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    by_folder = read_jsonl_corpus(spark, f"{tmp_dir}/one-scan/*", "id long, text string", keep=["id"], domain="one-scan/([^/]*)/")
    assert {r.id: r.domain for r in by_folder.collect()}[1] == "a"
