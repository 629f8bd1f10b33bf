"""Composed corpora by key: one build per shared node, and builders that race."""

import pytest
from pyspark.sql import functions as F

from corpusflow.plans.catalog import Catalog, corpus_catalog, default_catalog
from corpusflow.sources.sinks import materialise_once

SF = "/root/testdata/sf0.001"


def test_each_shared_node_is_built_once(spark):
    built = []

    def node(name, *cols):
        def build(*tables):
            built.append(name)
            return tables[0].select("doc_id", *[F.lit(c).alias(c) for c in cols])

        return build

    cat = Catalog()
    cat.register("docs", lambda s, b: s.read.parquet(f"{b}/documents.parquet"))
    cat.compose("tokens", ["docs"], node("tokens"), "test-a")
    cat.compose("blocks", ["tokens"], node("blocks"), "test-a")
    cat.compose("both", ["blocks", "tokens"], node("both", "x"), "test-a")
    cat.compose("other", ["blocks"], node("other"), "test-a")
    for key in ("both", "other", "both", "tokens"):
        assert cat.get(spark, key, SF).count() == cat.get(spark, "docs", SF).count()
    assert sorted(built) == ["blocks", "both", "other", "tokens"]
    with pytest.raises(KeyError, match="unknown keys"):
        cat.compose("bad", ["none"], node("bad"))


def test_composed_keys_and_their_domains(spark):
    keys = default_catalog().keys()
    assert {"documents+all", "documents+noise", "documents+mix", "documents+tails"} <= set(keys)
    mix = corpus_catalog(spark, "documents+tails-mix", SF)
    assert {r.domain for r in mix.select("domain").distinct().collect()} == {"mix"}
    with pytest.raises(KeyError, match="Unknown domain"):
        corpus_catalog(spark, "documents+all-none", SF)


def test_racing_builders_share_one_build(spark, tmp_dir):
    path = f"{tmp_dir}/t"

    def slow():
        materialise_once(lambda: spark.range(3), path, spark)  # another driver is done first
        return spark.range(5)

    assert materialise_once(slow, path, spark).count() == 3
    assert materialise_once(lambda: spark.range(9), path, spark).count() == 3
