import glob
import zipfile

import pytest

from corpusflow.session import checkpoint_root, input_version, materialise, scratch_path, ship_package
from corpusflow.sources import fs


def test_ship_package_zip(spark):
    ship_package(spark)
    ship_package(spark)  # idempotent per application
    zips = glob.glob(f"{checkpoint_root(spark)}/corpusflow/pyfiles/corpusflow-*.zip")
    assert zips
    names = zipfile.ZipFile(sorted(zips)[-1]).namelist()
    assert "corpusflow/__init__.py" in names and "corpusflow/plans/index.py" in names


def test_scratch_paths_are_fresh_and_shared(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(checkpoint_root(spark))
    back = materialise(spark.range(5), "t")
    assert back.count() == 5


def test_paths_resolve_as_spark_resolves_them(spark, tmp_dir):
    assert fs.qualify(spark, f"{tmp_dir}/x/") == f"file:{tmp_dir}/x"
    assert fs.resolve(f"file:{tmp_dir}/x")[1] == fs.resolve(f"file://{tmp_dir}/x")[1] == f"{tmp_dir}/x"
    assert fs.SCHEMES["s3a"] == "s3"
    for bad in ("dbfs:/x", "relative/x"):
        with pytest.raises(ValueError):
            fs.resolve(bad)
    fs.write_atomic(f"file:{tmp_dir}/x/y.bin", b"1")
    assert fs.is_there(spark, f"{tmp_dir}/x/y.bin") and not fs.is_there(spark, f"{tmp_dir}/x/z.bin")


def test_rewritten_input_has_another_version(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.range(5).write.parquet(path)
    first = input_version(spark, path)
    assert input_version(spark, path) == first
    spark.range(6).write.mode("overwrite").parquet(path)
    assert input_version(spark, path) != first
