"""Connected components by alternating large-star and small-star steps.

Every step is two shuffles of the edges that are left and its result is written to the shared folder,
so nothing depends on the lineage of earlier rounds. Minima are combined before the shuffle, and written
before they are joined, so that Spark can split the join of a node with very many neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialise


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j: each element's label is the least index of its set."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            short = labels[labels]
            if (short == labels).all():
                break
            labels[:] = short


def _linked_to_least(pairs: DataFrame, name: str) -> DataFrame:
    """(u, v, m) for pairs (u, v): m is the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = materialise(least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), name)
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the least node that it can reach.

    Nodes are longs. Loops and edges with a null end are ignored, repeated edges count once.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges = materialise(edges.distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both, "links-min").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "links-large")
        small = _linked_to_least(large, "links-min")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialise(small.where("u != v").distinct(), "links-small")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
