import datetime as dt

from pyspark.sql import functions as F

from corpusflow.streaming.reports import stream_metric_rollup, stream_token_report


def test_stream_token_report_counts(spark, tmp_dir):
    df = spark.createDataFrame(
        [(0, "abé", "s1"), (1, "xyz", "s1"), (2, "", "s2")], "doc_id long, text string, source string"
    )
    df.write.parquet(f"{tmp_dir}/in")
    out = stream_token_report(spark, f"{tmp_dir}/in", df.schema, f"{tmp_dir}/out", f"{tmp_dir}/ck")
    got = {r.domain: (r.n_docs, r.n_tokens) for r in out.collect()}
    assert got == {"s1": (2, 5), "s2": (1, 0)}


def test_watermark_closes_windows_and_drops_late_rows(spark, tmp_dir):
    import time

    schema = "ts timestamp_ntz, event_type string, value double"
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    files = [
        [(t(1, 1), "loss", 1.0), (t(1, 5), "loss", 2.0), (t(3, 2), "loss", 3.0)],
        [(t(3, 4), "loss", 4.0)],  # next batch: day 1 is now behind the watermark and is emitted
        [(t(1, 9), "loss", 100.0)],  # arrives after day 1 was emitted: dropped as late
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{i}")
        time.sleep(1.1)  # file order = arrival order
    src = spark.read.parquet(f"{tmp_dir}/in/0").schema
    out = stream_metric_rollup(
        spark, f"{tmp_dir}/in/*", src, f"{tmp_dir}/out", f"{tmp_dir}/ck", max_files=1,
    )
    rows = {(r.window_start.day, r.event_type): (r.n, r.value_sum, r.last_value) for r in out.collect()}
    # day 1 is written once, without the late row; day 3 is still open (watermark day 3 03:00)
    assert rows == {(1, "loss"): (2, 3.0, 2.0)}


def test_report_equals_the_batch_report_after_a_replayed_epoch(spark, tmp_dir):
    import shutil
    import time

    from corpusflow.operators.aggregates import domain_token_report
    from corpusflow.operators.tokens import tokenize_char
    from corpusflow.streaming.reports import read_token_report

    files = [
        [(0, "abé", "s1", "train"), (1, "xyz", None, "train")],
        [(2, "", "s2", "val"), (3, "hello", "s1", "train")],
        [(4, "more", None, "train"), (5, "x", "s1", "val")],
    ]
    schema = "doc_id long, text string, source string, part string"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{i}")
        time.sleep(1.1)
    docs = spark.read.schema(schema).parquet(f"{tmp_dir}/in/*")
    src = docs.schema

    def run():
        return stream_token_report(
            spark, f"{tmp_dir}/in/*", src, f"{tmp_dir}/out", f"{tmp_dir}/ck", split_col="part", max_files=1
        )

    def rows(df):
        return sorted((r.split, r.domain or "-", r.n_docs, r.n_tokens) for r in df.collect())

    batch = domain_token_report(tokenize_char(docs.selectExpr("doc_id", "text", "source domain", "part split")))
    assert rows(run()) == rows(batch)
    # the last epoch is run again, as after a crash before its commit; its half-written version is replaced
    for sub in ("ck/commits/2", "ck/commits/.2.crc", "out/epoch-2/_SUCCESS"):
        path = f"{tmp_dir}/{sub}"
        shutil.move(path, f"{tmp_dir}/aside-{sub.replace('/', '-')}")
    before = read_token_report(spark, f"{tmp_dir}/out", src, with_all=True)
    assert len(before.collect()) < batch.count() + 1 and rows(before) != rows(batch)
    assert rows(run()) == rows(batch)
