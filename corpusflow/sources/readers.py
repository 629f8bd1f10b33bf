"""Readers: JSONL corpora, split tables, whole files, archives, year partitions, token files.

All readers return lazy DataFrames; schemas are explicit where the format
would otherwise be inferred, so unused nested fields (``meta``) are never
parsed into the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources import fs

# The year range of the paper corpus.
ALL_YEARS = tuple(range(1992, 2004))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_jsonl_corpus(
    spark: SparkSession,
    paths: dict[str, str] | str | Sequence[str],
    schema: str,
    text_col: str = "text",
    keep: Sequence[str] = (),
    domain: str = r"([^/]*?)(?:\.jsonl?)?(?:\.(?:gz|bz2|zst))?$",
) -> DataFrame:
    """JSONL sources with their ``domain``; ``meta`` and other fields are not selected.

    One scan, however many domains: a path, a glob or several, where the first group of ``domain`` in a file's path
    (by default its name without endings) names the domain. With a dict, domains are its keys and each
    path is a file or folder; the longest one that a file lies in names its domain.
    """
    places = list(paths.values()) if isinstance(paths, dict) else paths
    rows = spark.read.schema(schema).json(places)
    file = F.col("_metadata.file_path")
    if isinstance(paths, dict):
        named = sorted(((fs.qualify(spark, path), d) for d, path in paths.items()), key=lambda x: -len(x[0]))
        # the place of a file as Spark shows it, without the slashes that some schemes repeat
        shown = F.regexp_replace(F.try_url_decode(F.regexp_replace(file, r"\+", "%2B")), "^file:/+", "file:/")
        name = F.lit(None).cast("string")
        for path, d in reversed(named):
            path = "file:/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path
            name = F.when((shown == path) | shown.startswith(f"{path}/"), F.lit(d)).otherwise(name)
    else:
        name = F.regexp_extract(file, domain, 1)
    return rows.select(*keep, text_col, name.alias("domain"))


def read_jsonl_glob(spark: SparkSession, directory: str, prefix: str, schema: str) -> DataFrame:
    """Every file or folder in ``directory`` whose name starts with ``prefix``, as one corpus."""
    return spark.read.schema(schema).json(f"{directory.rstrip('/')}/{prefix}*")


def read_split_table(
    spark: SparkSession,
    paths_by_split: dict[str, str],
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """Parquet tables that arrive split; ``test`` is renamed ``val`` by default."""
    rename = {"test": "val"} if rename is None else rename
    frames = [
        spark.read.parquet(path).withColumn("split", F.lit(rename.get(split, split)))
        for split, path in paths_by_split.items()
    ]
    return _union(frames)


def read_table_corpus(
    spark: SparkSession, path: str, text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """An unsplit table reduced to its text column (``text`` or ``markdown``...)."""
    return spark.read.parquet(path).select(*keep, F.col(text_col).alias("text"))


def read_whole_files(spark: SparkSession, globs_by_split: dict[str, str]) -> DataFrame:
    """One row per text file ``(split, path, text)``; the split comes from the file location."""
    frames = [
        spark.read.text(glob, wholetext=True).select(
            F.lit(split).alias("split"), F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("text"),
        )
        for split, glob in globs_by_split.items()
    ]
    return _union(frames)


ARCHIVE_SCHEMA = "archive string, member string, content string"


#: Unpacked bytes of the zip members that a task reads at a time, and of a batch of rows.
PART_BYTES, BATCH_BYTES = 64_000_000, 8_000_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path) to (path, first, stop): runs of a zip's members, by its index; a tar is one run without numbers."""
    import zipfile

    for batch in batches:
        rows: list = []
        for path in batch.column(0).to_pylist():
            if not path.endswith(".zip"):
                rows.append((path, None, None))
                continue
            store, place = fs.resolve(path)
            with store.open_input_file(place) as f, zipfile.ZipFile(f) as zf:
                first, size, infos = 0, 0, zf.infolist()
                for i, info in enumerate(infos):
                    if i > first and size + info.file_size > PART_BYTES:
                        rows.append((path, first, i))
                        first, size = i, 0
                    size += info.file_size
                rows.append((path, first, len(infos)))
        cols = list(zip(*rows)) or [(), (), ()]
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "first", "stop"])


def _members(path: str, first: int | None, stop: int | None) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files of an archive, or of a run of a zip's members, one after the other."""
    import tarfile
    import zipfile

    store, place = fs.resolve(path)
    if first is not None:
        with store.open_input_file(place) as f, zipfile.ZipFile(f) as zf:
            for info in zf.infolist()[first:stop]:
                if not info.is_dir():
                    yield info.filename, zf.read(info)
        return
    # unpacked by tarfile itself, whatever the compression
    with store.open_input_stream(place, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tf:
        for m in tf:
            if m.isfile():
                yield m.name, tf.extractfile(m).read()
            tf.members = []  # a stream does not go back, so what it has passed is not kept


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, first, stop) to (archive, member, content), in batches of about BATCH_BYTES."""
    names = ["archive", "member", "content"]

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    for batch in batches:
        for path, first, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows, size = [], 0
            for name, data in _members(path, first, stop):
                rows.append((path, name, data.decode("utf-8", "replace")))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield rows_of(rows)
                    rows, size = [], 0
            if rows:
                yield rows_of(rows)


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    """Zip / tar(.gz) archives -> one row per member ``(archive, member, content)``.

    Spark lists the archives without reading them. A tar is read as a stream by one task; the members of a zip are dealt out to
    many tasks by its index. A task holds a batch of members, never an archive.
    """
    listed = spark.read.format("binaryFile").load(glob).select("path")
    parts = listed.mapInArrow(_parts, "path string, first long, stop long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n).mapInArrow(_unpack, ARCHIVE_SCHEMA)


def read_year_partitions(
    spark: SparkSession,
    path: str,
    years: Sequence[int] | None = None,
    all_years: Sequence[int] = ALL_YEARS,
    year_col: str = "year",
) -> DataFrame:
    """Selected years of a year-partitioned table, in the requested order.

    Unknown years are rejected before any job runs; the filter on the
    partition column prunes partitions at planning time. ``year_order`` is the
    position of the year in the request (for ordered concatenation).
    """
    years = list(all_years) if years is None else list(years)
    unknown = sorted(set(years) - set(all_years))
    if unknown:
        raise ValueError(f"unknown years {unknown}; available {min(all_years)}-{max(all_years)}")
    order = F.array_position(F.array(*[F.lit(y) for y in years]), F.col(year_col)) - 1
    return (
        spark.read.parquet(path)
        .where(F.col(year_col).isin(years))
        .withColumn("year_order", order.cast("long"))
    )


TOKEN_PIECE_SCHEMA = "split string, domain string, offset long, n_tokens long, ids array<int>"


def read_token_bin(spark: SparkSession, glob: str, piece_len: int = 1 << 16) -> DataFrame:
    """Flat little-endian ``uint16`` token files -> located pieces.

    For any files ``<root>/<split>/<domain>/<first_pos>.bin`` (or ``<first_pos>-<name>.bin``), with or without a
    manifest; :func:`corpusflow.sources.tokens.read_token_stream` reads committed streams by position.
    Each file becomes pieces of at most ``piece_len`` ids with their stream
    ``offset``; :func:`corpusflow.operators.mixing.rebase` turns them into
    blocks of any length. Decoding is one ``np.frombuffer`` per file and the
    pieces are Arrow list slices of it (no per-token Python).
    """
    raw = spark.read.format("binaryFile").load(glob).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            paths = rb.column("path").to_pylist()
            blobs = rb.column("content")
            for i, path in enumerate(paths):
                parts = path.rstrip("/").split("/")
                split, domain, name = parts[-3], parts[-2], parts[-1]
                first = int(name.split(".")[0].split("-")[0])
                ids = np.frombuffer(blobs[i].as_buffer(), dtype="<u2").astype(np.int32)
                starts = np.arange(0, len(ids), piece_len, dtype=np.int64)
                if len(starts) == 0:
                    continue
                ends = np.minimum(starts + piece_len, len(ids))
                offsets = np.append(starts, len(ids)).astype(np.int32)
                k = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([split] * k, pa.string()),
                        pa.array([domain] * k, pa.string()),
                        pa.array(first + starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                    ],
                    names=["split", "domain", "offset", "n_tokens", "ids"],
                )

    return raw.mapInArrow(decode, TOKEN_PIECE_SCHEMA)
