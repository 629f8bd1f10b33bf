import math

from pyspark.sql import functions as F

from corpusflow.operators import splits
from corpusflow.operators.splits import (
    split_fraction,
    split_nested_halves,
    split_prefix,
    split_round_robin,
    split_shuffled,
)


def test_split_shuffled_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id").withColumn("domain", F.lit("d"))
    a = split_shuffled(df, "doc_id", 0.05, 2357, ["domain"])
    counts = dict(a.groupBy("split").count().collect())
    assert counts == {"val": math.ceil(0.05 * 1000), "train": 1000 - 50}
    b = split_shuffled(df.repartition(13), "doc_id", 0.05, 2357, ["domain"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_share_giving_zero_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    out = split_shuffled(df, "doc_id", 0.0, 1)
    assert out.where("split = 'val'").count() == 0


def test_tiny_share_rounds_up(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    assert split_shuffled(df, "doc_id", 0.0005, 1).where("split = 'val'").count() == 1


def test_nested_halves(spark):
    df = spark.range(101).withColumnRenamed("id", "doc_id")
    out = split_nested_halves(df, "doc_id", 0.1, 7)
    counts = dict(out.groupBy("split").count().collect())
    assert counts["val"] == 11
    assert counts["train2"] == math.ceil(0.5 * 90) and counts["train1"] == 90 - 45
    assert out.select("doc_id").distinct().count() == 101


def test_nested_cuts_come_from_one_count(spark, tmp_dir):
    """Both cuts equal those of one threshold after the other, and texts are in no exchange."""
    n = 3000
    rows = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN NULL ELSE 'b' END AS domain", "repeat('x', 50) AS text")
    rows.write.parquet(f"{tmp_dir}/nested")
    rows = spark.read.parquet(f"{tmp_dir}/nested")
    for share in (0.0, 0.05, 0.5, 1.0):
        for parts in ([], ["domain"]):
            both = split_nested_halves(rows, "doc_id", share, 7, parts)
            single = splits._one_by_one(rows, "doc_id", share, 7, parts, "split")
            assert sorted(both.select("doc_id", "split").collect()) == sorted(single.select("doc_id", "split").collect())
            plan = both._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_nested_halves_of_repeated_ids(spark):
    df = spark.createDataFrame([(None,)] * 60 + [(5,)] * 41, "doc_id long")
    counts = dict(split_nested_halves(df, "doc_id", 0.1, 7).groupBy("split").count().collect())
    assert counts == {"val": 11, "train2": 45, "train1": 45}
    assert split_nested_halves(df.where("doc_id > 9"), "doc_id", 0.1, 7).count() == 0


def test_round_robin_ten_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    out = {r.doc_id: r.split for r in split_round_robin(df, ["doc_id"]).collect()}
    assert [out[i] for i in range(10)] == ["train"] * 7 + ["val"] * 2 + ["test"]


def test_split_prefix_cuts_inside_text(spark):
    df = spark.createDataFrame([(0, "abcde"), (1, "fghij")], "doc_id long, text string")
    out = {(r.doc_id, r.split): r.text for r in split_prefix(df, "text", ["doc_id"], 0.8).collect()}
    assert out == {(0, "train"): "abcde", (1, "train"): "fgh", (1, "val"): "ij"}


def test_split_fraction_floor(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    out = split_fraction(df, "k", 0.5, 3)
    assert out.where("split = 'train'").count() == 3
