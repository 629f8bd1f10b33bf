import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.plans.index import hash_bucket, head_flag, ordered_index, range_buckets


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ordered_index_equals_global_window(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("abc"), i, rng.randint(0, 50)) for i in range(0, 3000, 3)]
    df = spark.createDataFrame(rows, "g string, id long, w long").repartition(parts)
    got = ordered_index(df, ["id"], ["g"], weight="w").select("g", "id", "_idx", "_n", "_start", "_total")
    w = Window.partitionBy("g").orderBy("id")
    ref = df.select(
        "g", "id",
        (F.row_number().over(w) - 1).alias("_idx"),
        F.count("*").over(Window.partitionBy("g")).alias("_n"),
        F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("w").over(Window.partitionBy("g")).alias("_total"),
    )
    assert sorted(got.collect()) == sorted(ref.collect())


def test_ordered_index_hash_bucket_no_partition(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    got = ordered_index(df, ["k", "id"], bucket=hash_bucket("k", 2)).select("id", "_idx")
    ref = df.select("id", (F.row_number().over(Window.orderBy("k", "id")) - 1).alias("_idx"))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_ordered_index_any_type_and_outliers(spark):
    ids = [*range(400), 2**62, -(2**62)]
    df = spark.createDataFrame([(i, f"path/{i}") for i in ids], "id long, path string")
    for col, order in (("id", sorted(ids)), ("path", sorted(f"path/{i}" for i in ids))):
        got = {r[col]: r["_idx"] for r in ordered_index(df, [col]).collect()}
        assert got == {v: k for k, v in enumerate(order)}


def test_outlier_leaves_buckets_even(spark):
    df = spark.createDataFrame([(i,) for i in [*range(20_000), 2**62]], "id long").withColumn("g", F.lit("x"))
    sizes = [r["count"] for r in range_buckets(df, ["g"], ["id"]).groupBy("_bkt").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * (20_001 / len(sizes))


def test_repeated_keys_at_the_cut_fail(spark):
    df = spark.createDataFrame([(1, "a")] * 100, "id long, g string").withColumn("k", F.md5(F.col("id").cast("string")))
    share = lambda n: F.ceil(F.lit(0.05) * n.cast("double"))
    with pytest.raises(Exception, match="must be unique"):
        head_flag(df, ["k", "id"], ["g"], hash_bucket("k", 2), share).collect()
    with pytest.raises(ValueError, match="must be unique"):
        head_flag(df, ["k", "id"], [], hash_bucket("k", 2), share).collect()


@pytest.mark.parametrize("share", [0.0, 0.013, 0.5, 1.0])
def test_head_flag_equals_rank_cut(spark, share):
    import math

    rng = random.Random(7)
    rows = [(rng.choice("abcd"), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, id long").withColumn(
        "k", F.md5(F.col("id").cast("string"))
    )
    cut = lambda n: F.ceil(F.lit(share) * n.cast("double"))
    for parts in (["g"], []):
        got = {r.id: r._head for r in head_flag(df, ["k", "id"], parts, hash_bucket("k", 2), cut).collect()}
        w = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        ref = df.select(
            "id",
            (F.row_number().over(w.orderBy("k", "id")) - 1).alias("r"),
            F.count("*").over(w).alias("n"),
        ).collect()
        want = {r.id: r.r < math.ceil(share * r.n) for r in ref}
        assert got == want


def test_token_ids_pass_packed_and_unchanged(spark):
    rows = [(g, i, None if i % 5 == 0 else [i * 100] * (i % 4)) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id long, ids array<int>")
    got = ordered_index(df, ["id"], ["g"])
    assert sorted(map(repr, got.select("g", "id", "ids").collect())) == sorted(map(repr, df.collect()))
    stored = dict(range_buckets(df.withColumn("ids", F.lit(b"\x01")), ["g"], ["id"], None, 1).dtypes)
    assert stored["ids"] == "binary" and got.where("_idx != id").isEmpty()
