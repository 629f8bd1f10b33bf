"""WARC archives with revisit records for repeated payloads.

Headers (id, url, digest, length) are written as a narrow table and grouped by payload digest, first by id within it, to find
the original of each repeated payload. Revisit records have no payload, so they are made of headers alone. Pages of small
payloads become responses as they are scanned; larger ones are compared with the repeated digests, a
written table that the planner broadcasts while it is small. A WARC record ends in two line ends,
which Spark's text sink can write after every row: archives go through Spark's own commit protocol, to
any file system it knows, and a task that is tried again leaves no second copy. Archives are read as streams, a record at a time.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialise, scratch_path
from corpusflow.sources import fs

MIN_BYTES = 1000
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no fetch time; a fixed one keeps reruns equal
SCHEMA = (
    "record_id string, warc_type string, page_id long, uri string, payload_digest string, "
    "refers_to_id string, payload binary"
)


BATCH_BYTES = 4_000_000  # payloads in a batch of parsed records


def headers_of(pages: DataFrame) -> DataFrame:
    """The narrow header of every page (id, url, payload), with a number of its own, as a written table."""
    rows = pages.select("_id", "_url", F.sha1(F.col("_payload").cast("binary")).alias("_digest"), _length().alias("_bytes"))
    return materialise(rows.withColumn("_uid", F.monotonically_increasing_id()), "warc-headers")


def _length():
    return F.octet_length("_payload").cast("long")


def repeated(headers: DataFrame, min_bytes: int) -> DataFrame:
    """A row per digest of several headers of ``min_bytes`` or more: the number and url of its original, ``_first`` its id.

    The original has the largest id (null is the smallest); ``_same`` headers have that id, and the one with the
    largest number is taken. Rows are added up by (digest, id) first, so a hot digest is no hot group.
    """
    large = headers.where(F.col("_bytes") >= min_bytes)
    ids = large.groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_uid", "_url")).alias("at"))
    groups = ids.groupBy("_digest").agg(F.max(F.struct("_id", "n", "at")).alias("top"), F.sum("n").alias("_n"))
    groups = groups.where("_n > 1").selectExpr(
        "_digest", "top._id AS _first", "top.n AS _same", "top.at._uid AS _original", "top.at._url AS _first_url"
    )
    return materialise(groups, "warc-repeated")


def records_of(pages: DataFrame, min_bytes: int) -> DataFrame:
    """A row per record of ``pages`` (id, url, payload): digest, length, ``_payload`` (null: a revisit), ``_first``, ``_name``.

    ``_name`` tells records of one page id apart: the digest in originals, which revisits refer to.
    """
    headers = headers_of(pages)
    groups = repeated(headers, min_bytes)
    large = headers.where(F.col("_bytes") >= min_bytes)
    again = large.join(groups, "_digest").where("_uid <> _original").select(
        "_id", "_url", F.lit(None).cast("string").alias("_payload"), "_digest", "_bytes", "_first",
        F.concat(F.lit("r"), F.col("_uid").cast("string")).alias("_name"),
    )
    own = pages.withColumns({"_bytes": _length(), "_digest": F.sha1(F.col("_payload").cast("binary"))})
    small = own.where(F.col("_bytes") < min_bytes).withColumn("_named", F.lit(None).cast("string"))
    found = groups.select(F.col("_digest").alias("_named"), "_first", "_same")
    one = own.where(F.col("_bytes") >= min_bytes).join(found, F.col("_digest") == F.col("_named"), "left")
    one = one.where(F.col("_named").isNull() | ((F.col("_same") == 1) & F.col("_id").eqNullSafe(F.col("_first"))))
    parts = [small, one.select(*small.columns)]
    twins = groups.where("_same > 1")
    if not twins.isEmpty():
        # Originals that are repeated rows: a payload of each digest, reduced inside the tasks first.
        rows = own.where(F.col("_bytes") >= min_bytes).join(twins, "_digest").where(F.col("_id").eqNullSafe(F.col("_first")))
        rows = rows.groupBy("_digest").agg(*[F.first(c).alias(c) for c in ("_id", "_first_url", "_payload", "_bytes")])
        parts.append(rows.select("_id", F.col("_first_url").alias("_url"), "_payload", "_bytes", "_digest", F.col("_digest").alias("_named")))
    responses = parts[0]
    for part in parts[1:]:
        responses = responses.unionByName(part)
    number = F.monotonically_increasing_id().cast("string")
    responses = responses.select(
        "_id", "_url", "_payload", "_digest", "_bytes", F.lit(None).cast(again.schema["_first"].dataType).alias("_first"),
        F.coalesce("_named", number).alias("_name"),
    )
    return responses.unionByName(again)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_BYTES,
    records_per_file: int = 1000,
) -> None:
    """Write one WARC record per page: a response with its payload, or a revisit of an equal payload.

    Null payloads are empty; null urls become ``urn:page:<id>``. Line ends in urls are dropped, so a
    header stays one line. Repeated rows (also of a null id) get records of their own ids. Other columns
    are ignored. No pages: archives without records.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    rows = records_of(pages, min_bytes)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    name = lambda c, of: F.concat(F.lit("<urn:page:"), shown(c), F.lit(":"), F.col(of), F.lit(">"))
    uri = F.coalesce(F.regexp_replace(F.col("_url"), r"[\r\n]", ""), F.concat(F.lit("urn:page:"), shown("_id")))
    is_revisit = F.col("_payload").isNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.concat(http, F.coalesce("_payload", F.lit("")))
    refers = F.when(
        is_revisit,
        F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("_first", "_digest"), F.lit("\r\n")),
    ).otherwise(F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name("_id", "_name"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("_digest"),
        F.lit("\r\n"),
        refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
    )
    (
        rows.select(record.alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip")
        .text(path)
    )


def parse_archive(stream: BinaryIO) -> Iterator[dict]:
    """Records of one archive, one after the other; lengths, not separators, say where a record ends."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            field, colon, value = line.decode().removesuffix("\r\n").partition(": ")
            if not colon:
                raise ValueError(f"no header line: {line[:40]!r}")
            head[field] = value
        block = stream.read(int(head["Content-Length"]))
        http = block.find(b"\r\n\r\n") + 4
        if len(block) != int(head["Content-Length"]) or http < 4 or stream.read(len(RECORD_END)) != RECORD_END.encode():
            raise ValueError(f"broken record {head['WARC-Record-ID']}")
        page = head["WARC-Record-ID"].removeprefix("<urn:page:").rpartition(":")[0]
        yield {
            "record_id": head["WARC-Record-ID"],
            "warc_type": head["WARC-Type"],
            "page_id": None if page == "null" else int(page),
            "uri": head["WARC-Target-URI"],
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to_id": head.get("WARC-Refers-To"),
            "payload": block[http:] if head["WARC-Type"] == "response" else None,
        }


def read_archives(spark, path: str) -> DataFrame:
    """A row per record of the archives below ``path``; revisit records have no payload.

    Spark lists the archives without reading them; a task reads one as a stream and holds a batch of records.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in SCHEMA.split(", "))])

    def parse(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, place = fs.resolve(file)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as raw:
                    for row in parse_archive(gzip.GzipFile(fileobj=raw) if place.endswith(".gz") else raw):
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInArrow(parse, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the digest and length of the full payload, for revisits from the response they refer to."""
    own = records.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to_id",
        "payload_digest",
        F.sha1("payload").alias("own_digest"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    own = materialise(own, "warc-read")
    # Originals are named by their digest; one row per name, so that no revisit is repeated.
    is_original = F.col("record_id").endswith(F.concat(F.lit(":"), F.col("payload_digest"), F.lit(">")))
    wanted = materialise(
        own.where("warc_type = 'response'").where(is_original).groupBy(
            F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest")
        ).agg(
            F.first("own_digest").alias("full_digest"),
            F.first("own_bytes").alias("full_bytes"),
            F.first("page_id").alias("_page"),
        ),
        "warc-responses",
    )
    out = own.join(
        wanted, (F.col("refers_to_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left"
    )
    return out.select(
        "page_id",
        F.coalesce("own_bytes", "full_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "full_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("_page").alias("refers_to"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as deduplicated archives below ``path`` and return their resolved records.

    A row per page, also for null ids, null or empty payloads and repeated rows (of equal rows that hold an original, one
    is the response). No pages: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return resolve(read_archives(spark, path))
