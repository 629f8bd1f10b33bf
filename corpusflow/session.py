"""Session construction and the shared scratch folder.

Everything a job writes as an intermediate (materialised tables, derived
files) goes below the cluster's shared ``spark.checkpoint.dir``; a folder of
our own is chosen only when the session has none (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(
    app: str = "corpusflow",
    cpus: int | str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
) -> SparkSession:
    """A local session configured like the cluster jobs expect (AQE on, UTC)."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Only a local master without either (tests, laptops) gets a folder of its own, once per session;
    on a cluster a missing folder is an error, since executors cannot see the driver's disk.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/corpusflow/{name}-{uuid.uuid4().hex[:12]}"


#: Tokens that a task sorts or joins at a time: 32 MB packed, so four tasks of an executor sort them in memory.
TASK_TOKENS = 1 << 25


def tasks_for(spark: SparkSession, n_tokens: int | None) -> int:
    """Tasks to deal ``n_tokens`` out to: the session's number of shuffle partitions, more where each would get too many to sort in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_tokens or 0) // TASK_TOKENS))


def dealt(df: DataFrame, n: int, *keys) -> DataFrame:
    """``df`` dealt out by ``keys`` to ``n`` tasks; left to the planner while its own number of partitions is enough."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialise(df: DataFrame, name: str = "table", codec: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) to the shared folder and read it back.

    Cuts lineage in a way that survives executor loss (unlike a local
    checkpoint) and stops expensive upstream work (tokenisers) from being
    recomputed by operators that scan their input twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").options(**options).parquet(path, compression=codec)
    return spark.read.parquet(path)


def ensure_parallel(df: DataFrame, *key_cols: str) -> DataFrame:
    """Hash-repartition a freshly scanned table that has fewer splits than cores.

    Expensive per-row steps (tokenisers) run in the scan stage; a single
    Parquet row group gives a single task. At cluster scale inputs have many
    splits and this is a no-op; on small inputs it spreads rows over all
    cores. Call it on scan-only plans (asking an exchange plan for its
    partition count would run it).
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *key_cols) if key_cols else df.repartition(target)


def input_version(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of a Parquet table's files: another one once it is rewritten."""
    names = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"]
    files = spark.read.parquet(path).select(*names).distinct()
    found = files.agg(F.bit_xor(F.xxhash64(*files.columns)).alias("h")).first()["h"]
    return f"{(found or 0) & (1 << 64) - 1:016x}"


def cached_path(spark: SparkSession, key: str) -> str:
    """Where a derived table of this application lives; ``key`` names its inputs (with their version) and parameters."""
    import hashlib

    digest = hashlib.md5(f"{spark.sparkContext.applicationId}:{key}".encode()).hexdigest()[:16]
    return f"{checkpoint_root(spark)}/corpusflow/cache/{digest}"


def session_cached(spark: SparkSession, key: str, build) -> DataFrame:
    """Build a derived table once per application (shared folder), then reuse it.

    The path is keyed by the application id and ``key`` (which must name the
    inputs with their :func:`input_version`, and parameters), so neither another
    run nor rewritten input sees a stale copy; within a run, every operator over
    the same corpus reads one materialised build.
    """
    from corpusflow.sources.sinks import materialise_once

    return materialise_once(build, cached_path(spark, key), spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusflow`` importable in every Python worker of this application.

    UDFs defined in the package are pickled by reference, so executors must be
    able to import it. The package sources are zipped once into the shared
    folder (content-addressed name) and added with ``addPyFile``, which
    distributes them with the tasks; the driver's ``sys.path`` alone would
    not reach the workers. Set ``CORPUSFLOW_SHIP=0`` where the package is
    already installed on every executor.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or os.environ.get("CORPUSFLOW_SHIP") == "0":
        return
    import corpusflow
    from corpusflow.sources import fs

    pkg_dir = os.path.dirname(os.path.abspath(corpusflow.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in sorted(os.walk(pkg_dir)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    arc = os.path.relpath(full, os.path.dirname(pkg_dir))
                    zf.writestr(zipfile.ZipInfo(arc, date_time=(2020, 1, 1, 0, 0, 0)), open(full, "rb").read())
    data = buf.getvalue()
    path = fs.qualify(
        spark, f"{checkpoint_root(spark)}/corpusflow/pyfiles/corpusflow-{hashlib.md5(data).hexdigest()[:12]}.zip"
    )
    if not fs.is_there(spark, path):
        fs.write_atomic(path, data)
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
