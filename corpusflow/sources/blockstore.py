"""Block tables clustered by stream position, with an index of the files: random access to token streams.

A store is a folder of three Parquet tables: ``blocks`` (split, domain, block_id, n_tokens, ids), range-partitioned and sorted
by (split, domain, block_id) in files of a bounded number of blocks; ``index``, the intervals of blocks that each file
holds of each stream, one per stretch; and ``streams``, a row per stream with its length. A batch of windows looks up the files it touches
in the index and opens only those, so its cost follows the batch and not the corpus; lengths come from ``streams``.
``streams`` is written last: a store without its marker is not complete and is built again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.plans.index import join_same
from corpusflow.sources import fs

STREAM = ["split", "domain"]
BLOCKS_PER_FILE = 4096


@dataclass(frozen=True)
class BlockStore:
    """A store at ``path``; ``block_len`` ids per block (the last one of a stream may be shorter)."""

    spark: SparkSession
    path: str
    block_len: int

    def blocks(self) -> DataFrame:
        """The whole block table (split, domain, block_id, ids)."""
        return self.spark.read.parquet(f"{self.path}/blocks").drop("n_tokens")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def lengths(self) -> DataFrame:
        """(split, domain, ``stream_len``, ``n_blocks``) of every stream, from the index alone."""
        return self.spark.read.parquet(f"{self.path}/streams")

    def files_of(self, spans: DataFrame) -> list[str]:
        """Files with a block of the spans (split, domain, ``start``, ``length``), each once.

        Both sides meet on the stretch of blocks that they lie in, then by interval; no pair of a span and a
        file of another stretch is made. Meant for batches: the list has at most a few files per span.
        """
        size = BLOCKS_PER_FILE
        asked = spans.where("length > 0").select(
            *STREAM, F.floor(F.col("start") / self.block_len).alias("_a"),
            F.floor((F.col("start") + F.col("length") - 1) / self.block_len).alias("_b"),
        )
        asked = asked.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))))
        held = self.index().withColumn(
            "_stretch", F.explode(F.sequence(F.floor(F.col("first_block") / size), F.floor(F.col("last_block") / size)))
        )
        hits = join_same(asked, held, [*STREAM, "_stretch"]).where("_a <= last_block and first_block <= _b")
        return sorted(r["file"] for r in hits.select("file").distinct().collect())

    def covering(self, spans: DataFrame) -> DataFrame:
        """The blocks of the files that the spans touch; nothing else is opened."""
        files = self.files_of(spans)
        if not files:
            return self.blocks().where(F.lit(False))
        return self.spark.read.schema(self._schema()).parquet(*files).drop("n_tokens")

    def _schema(self):
        return self.spark.read.parquet(f"{self.path}/blocks").schema


def write_block_store(
    blocks: DataFrame, path: str, block_len: int, blocks_per_file: int = BLOCKS_PER_FILE, partitions: int | None = None,
    in_order: bool = False,
) -> BlockStore:
    """Write a block table (split, domain, block_id, ids) as a store; what an interrupted build left there is replaced.

    ``in_order``: the tasks of ``blocks`` hold stretches of blocks that lie side by side (as :func:`pack_blocks` leaves
    them), so they are written where they are and no id is shuffled again.
    """
    spark = blocks.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*STREAM, "block_id"]
    rows = blocks.select(*keys, F.size("ids").cast("long").alias("n_tokens"), "ids")
    if not in_order:
        rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").option("maxRecordsPerFile", blocks_per_file).parquet(f"{path}/blocks", compression="zstd")
    written = spark.read.parquet(f"{path}/blocks")
    stretch = F.floor(F.col("block_id") / BLOCKS_PER_FILE).alias("_stretch")  # a file may hold several, far apart
    index = written.groupBy(F.col("_metadata.file_path").alias("file"), *STREAM, stretch).agg(
        F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"),
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"),
    ).drop("_stretch")
    index.repartition(max(1, n // 8)).write.mode("overwrite").parquet(f"{path}/index")
    streams = spark.read.parquet(f"{path}/index").groupBy(*STREAM).agg(
        F.sum("n_tokens").alias("stream_len"), F.sum("n_blocks").alias("n_blocks")
    )
    streams.coalesce(1).write.mode("overwrite").parquet(f"{path}/streams")
    return BlockStore(spark, path, block_len)


def block_store_once(
    build: Callable[[], DataFrame], path: str, spark: SparkSession, block_len: int, **options
) -> BlockStore:
    """The store at ``path``, built only if no complete one is there."""
    if fs.is_there(spark, f"{path}/streams/_SUCCESS"):
        return BlockStore(spark, path, block_len)
    return write_block_store(build(), path, block_len, **options)


def source_of(blocks: DataFrame | BlockStore, spans: DataFrame) -> DataFrame:
    """The blocks to read for ``spans``: the files of a store that they touch, or a whole block table."""
    return blocks.covering(spans) if isinstance(blocks, BlockStore) else blocks

