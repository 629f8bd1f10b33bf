"""Streaming queries: the token report and the watermarked metric roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans.catalog import table
from corpusflow.queries import sql
from corpusflow.queries.registry import register
from corpusflow.session import scratch_path
from corpusflow.streaming.reports import stream_metric_rollup, stream_token_report


@register(
    "stream_token_report",
    f"""SELECT source AS domain, count(*) AS n_docs, CAST(sum(length({sql.char_clean('text')})) AS BIGINT) AS n_tokens
FROM documents GROUP BY source""",
)
def q_stream_token_report(spark, base):
    schema = table(spark, base, "documents").schema
    return stream_token_report(
        spark, base, schema, scratch_path(spark, "stream-report"), scratch_path(spark, "stream-report-ckpt"),
        glob="documents.parquet",
    )


@register(
    "stream_token_report_by_split",
    f"""SELECT lang AS split, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS domain, count(*) AS n_docs,
  CAST(sum(length({sql.char_clean('text')})) AS BIGINT) AS n_tokens
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""",
)
def q_stream_token_report_by_split(spark, base):
    schema = table(spark, base, "documents").schema
    return stream_token_report(
        spark, base, schema, scratch_path(spark, "stream-report"), scratch_path(spark, "stream-report-ckpt"),
        glob="documents.parquet", split_col="lang",
    )


@register(
    "stream_metric_rollup",
    """WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS t, event_type, value FROM events),
w AS (SELECT time_bucket(INTERVAL 1 DAY, t) AS ws, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS value_sum,
  max_by(value, t) AS last_value FROM e GROUP BY ALL)
SELECT CAST(ws AS DATE) AS day, event_type, n, value_sum, last_value FROM w
WHERE ws + INTERVAL 1 DAY <= (SELECT max(t) - INTERVAL 1 HOUR FROM e)""",
)
def q_stream_metric_rollup(spark, base):
    schema = table(spark, base, "events").schema
    out = stream_metric_rollup(
        spark, base, schema, scratch_path(spark, "stream-rollup"), scratch_path(spark, "stream-rollup-ckpt"),
        glob="events.parquet",
    )
    return out.select(
        F.to_date("window_start").alias("day"), "event_type", "n",
        (F.round("value_sum", 6) + F.lit(0.0)).alias("value_sum"), "last_value",
    )
