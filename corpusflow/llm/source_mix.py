"""Mixing sources to target weights.

Documents get hash-random keys, are range-sorted by them within each source, and distributed prefix
sums of their sizes decide how often each is taken: whole epochs first, then the head of the order up
to the rest of the source's budget, cut inside the document that straddles it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.columns import passing
from corpusflow.llm.prefix import range_prefix
from corpusflow.session import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text as a long; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources in code point order (null last) weigh ``weights``, repeating. ``share`` of all sizes is
    dealt out by weight; a target stops at ``max_epochs`` times its source's size and the excess is
    dealt again among the others, until none is above. Only sums reach the driver.
    """
    ranked = range_prefix(
        sizes.withColumn("_one", F.lit(0)), "_one", [F.col("source").asc_nulls_last()], "source_size", "mix-sources"
    )
    cap = F.col("source_size") * float(max_epochs)
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("_row") % len(weights) + 1).cast("int")
    )
    ranked = materialise(ranked.select("source", "source_size", weight.alias("w"), cap.alias("cap")), "mix-weights")
    level, full = 0.0, -1
    while True:
        over = F.col("w") * level > F.col("cap")
        r = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("free"),
            F.sum(over.cast("long")).alias("full"),
        ).first()
        if r["all"] is None or not r["free"] or r["full"] == full:
            break
        full = r["full"] if level else -1
        level = (r["all"] * share - r["held"]) / r["free"]
    target = F.least(F.col("w") * F.lit(level), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def _order_key(seed: int, id_col: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per document: id, ``key``, ``text_md5``, source, ``size`` (words), ``source_size``, ``target`` and ``taken``.

    ``taken`` counts the words that the mix takes of the document, repeats included. Null text has
    size 0 and is taken 0 times; null sources form one source; repeated rows are documents of their
    own (their share is settled in any order, which leaves the rows as a whole the same). The order
    is md5 of seed and id, then md5 of the text, so reruns agree whatever the partitioning.
    """
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            _order_key(seed, id_col).alias("key"),
            F.md5(F.col(text_col)).alias("text_md5"),
        ),
        "mix-docs",
    )
    sizes = materialise(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, max_epochs), "mix-targets")
    ordered = range_prefix(
        narrow, "source", [F.col("key").asc(), F.col("text_md5").asc_nulls_first()], "size", "mix-order"
    )
    t = targets.withColumnRenamed("source", "_src")
    rows = ordered.join(t, F.col("source").eqNullSafe(F.col("_src")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("_budget", budget).withColumn("_epochs", epochs.cast("long"))
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_before")
    extra = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return rows.select(
        F.col("id").alias(id_col),
        "key",
        "text_md5",
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("_epochs") + extra).cast("long").alias("taken"),
    )


def take_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, the one at a source's budget cut there.

    All that a row needs to know is its source's number of whole epochs and the place of the cut, so the
    texts are not shuffled. Rows that repeat the id and the text at the cut are all cut alike. Null and empty
    texts have no word and are not taken. Other columns pass through, whatever their names.
    """
    used = (id_col, text_col, source_col)
    return passing(docs, used, lambda d: _taken(d, weights, share, max_epochs, seed, *used))


def _taken(docs, weights, share, max_epochs, seed, id_col, text_col, source_col) -> DataFrame:
    mixed = mix_sources(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    mixed = mixed.withColumn("epochs", epochs.cast("int")).withColumn("extra", F.col("taken") - F.col("size") * epochs)
    place = F.struct("key", F.coalesce("text_md5", F.lit("")).alias("tie"))
    # The last document that is taken once more is the one at the cut; a source has one row.
    last = F.max(F.when(F.col("extra") > 0, F.struct(place.alias("place"), F.col("extra"))))
    cuts = mixed.groupBy(F.col(source_col).alias("_src")).agg(F.max("epochs").alias("_epochs"), last.alias("_last"))
    cuts = materialise(cuts, "mix-cuts")
    rows = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("_src")))
    own = F.struct(_order_key(seed, id_col).alias("key"), F.coalesce(F.md5(text_col), F.lit("")).alias("tie"))
    rows = rows.withColumn("_own", own)
    before = F.coalesce(F.col("_own") < F.col("_last.place"), F.lit(False))
    at = F.coalesce(F.col("_own") == F.col("_last.place"), F.lit(False))
    rows = rows.withColumn("_at", at).withColumn("_more", (before | at).cast("int"))
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("_epochs") + F.col("_more")))).where("_nth > 0")
    # A piece of this split is a word with the white space before it.
    pieces = F.split(text_col, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_last.extra").cast("int")), "")
    text = F.when(F.col("_at") & (F.col("_nth") > F.col("_epochs")), cut).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
