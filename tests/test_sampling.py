from pyspark.sql import functions as F

from conftest import tok_frame
from corpusflow.operators.packing import pack_blocks
from corpusflow.operators.sampling import (
    batch_schedule,
    epoch_batches,
    epochs_needed,
    sample_domains_weighted,
    sample_windows,
    window_starts,
)

S = 4


def test_window_starts_borders(spark):
    t = spark.createDataFrame([("a", 4), ("b", 5), ("c", 9)], "domain string, stream_len long")
    got = {}
    for r in window_starts(t, S).collect():
        got.setdefault(r.domain, []).append(r.start)
    assert "a" not in got  # len = S: no window leaves a token for the shift
    assert got["b"] == [0]
    assert sorted(got["c"]) == [0, 4]


def test_windows_shift_by_one(spark):
    ids = list(range(50))
    rows = [("train", "a", 0, ids[:13]), ("train", "a", 1, ids[13:])]
    blocks = pack_blocks(tok_frame(spark, rows), 8, ["split", "domain"], ["doc_id"])
    for r in sample_windows(blocks, 8, S, 20, 3).collect():
        assert r.x == ids[r.start:r.start + S] and r.y == ids[r.start + 1:r.start + S + 1]
        assert r.start % S == 0


def test_weighted_domains_respect_zero_weight(spark):
    rows = [("train", "a", 0, list(range(40))), ("train", "b", 0, list(range(100, 140)))]
    blocks = pack_blocks(tok_frame(spark, rows), 8, ["split", "domain"], ["doc_id"])
    out = sample_domains_weighted(blocks, 8, S, 30, 1, weights={"a": 0.0, "b": 2.0}).collect()
    assert len(out) == 30 and {r.domain for r in out} == {"b"}
    assert all(r.x[0] >= 100 for r in out)


def test_epoch_batches_and_schedule(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    b = epoch_batches(df, "k", 4, 2, 9, n_total=20)
    sizes = sorted(b.where("epoch = 0").groupBy("batch").count().collect())
    assert [r["count"] for r in sizes] == [4, 4, 2]  # short last batch kept
    e0 = [r.k for r in b.where("epoch = 0").orderBy("batch", "pos").collect()]
    e1 = [r.k for r in b.where("epoch = 1").orderBy("batch", "pos").collect()]
    assert sorted(e0) == sorted(e1) == list(range(10)) and e0 != e1
    k, epochs = epochs_needed(10, 4, 20, 7)
    assert (k, epochs) == (3, 3)
    steps = sorted(r.step for r in batch_schedule(epoch_batches(df, "k", 4, epochs, 9, 20), 7, k)
                   .select("step").distinct().collect())
    assert steps == list(range(7))
    cut = epoch_batches(df, "k", 4, epochs, 9, 20, num_steps=7)
    whole = epoch_batches(df, "k", 4, epochs, 9, 20).where("epoch * 3 + batch < 7")
    assert sorted(cut.collect()) == sorted(whole.select(*cut.columns).collect()) and cut.count() == 24
    # batch size capped at ceil(n_total / 2)
    small = epoch_batches(df, "k", 512, 1, 9, n_total=10)
    assert small.agg(F.max("batch")).first()[0] == 1


def test_window_starts_of_very_long_streams_are_spread(spark):
    t = spark.createDataFrame([("x", 627_000_000_000)], "domain string, stream_len long")
    starts = window_starts(t, 128)
    assert starts.limit(3).count() == 3  # no array of all starts


def test_count_up_numbers_every_row(spark):
    from corpusflow.plans.generate import count_up

    t = spark.createDataFrame([("a", 10), ("b", 0), ("c", -2), ("d", None), ("e", 3)], "k string, n long")
    got = sorted((r["k"], r["i"]) for r in count_up(t, F.col("n"), "i", chunk=4).collect())
    assert got == [("a", i) for i in range(10)] + [("e", i) for i in range(3)]
