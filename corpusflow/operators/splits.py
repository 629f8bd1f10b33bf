"""Exact, seeded, partition-independent train/validation splits.

``randomSplit`` and ``sampleBy`` only give approximate shares. Shuffled
splits here order rows by an md5 key and cut at an exact row count through a
per-partition threshold (:func:`head_flag`, no row shuffle); order-based
splits (round robin, character prefix) use the exact rank / prefix sum of
:func:`ordered_index`, the latter over keys and lengths only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.hashing import seeded_key
from corpusflow.plans.index import HASH_DIGITS, TIED, attach, hash_bucket, head_flag, nested_thresholds, order_key, ordered_index
from corpusflow.session import materialise

# Fixed value: the seed used by the corpus builders.
DEFAULT_SEED = 2357


def _shuffled_head(df, id_col, seed, part_cols, head_size, flag_col):
    """Flag the first ``head_size(n)`` rows in md5(seed:id) order -- no row is shuffled.

    Rows of a null or repeated id stand side by side in the order; a cut among them is exact as well.
    """
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    flagged = head_flag(
        keyed, ["_key", id_col], part_cols, hash_bucket("_key"), head_size, flag_col, break_ties=True
    )
    return flagged.drop("_key")


def split_shuffled(
    df: DataFrame,
    id_col: str,
    val_share: float,
    seed=DEFAULT_SEED,
    part_cols: Sequence[str] = (),
    split_col: str = "split",
    names: tuple[str, str] = ("train", "val"),
) -> DataFrame:
    """Shuffled split with exactly ``ceil(val_share * n)`` validation rows per partition.

    Rows are ordered by ``md5(seed:id)``; the first ``ceil(share * n)`` are
    validation. Only the threshold key per partition is computed (see
    :func:`head_flag`), so labelling a corpus moves no text through a shuffle.
    A null domain is a partition like any other.
    """
    share = float(val_share)
    flagged = _shuffled_head(
        df, id_col, seed, part_cols, lambda n: F.ceil(F.lit(share) * n.cast("double")), "_val"
    )
    return flagged.withColumn(
        split_col, F.when(F.col("_val"), F.lit(names[1])).otherwise(F.lit(names[0]))
    ).drop("_val")


def split_nested_halves(
    df: DataFrame,
    id_col: str,
    val_share: float,
    seed=DEFAULT_SEED,
    part_cols: Sequence[str] = (),
    split_col: str = "split",
) -> DataFrame:
    """Split off ``val``, then cut the rest into ``train1`` and ``train2``.

    ``train2`` gets ``ceil(0.5 * n_train)`` rows drawn with a second key. Both thresholds come from one joint count
    (:func:`nested_thresholds`) and label every row in one pass over the texts. Where rows of a null or
    repeated id lie on both sides of a cut, the cuts are made one after the other, exact all the same.
    """
    share = float(val_share)
    sizes = lambda n: F.ceil(F.lit(share) * n.cast("double"))
    keys = {"_key1": seeded_key(seed, id_col), "_key2": seeded_key(f"{seed}:halves", id_col)}
    both = df.withColumns(keys)
    first, second = ["_key1", id_col], ["_key2", id_col]
    cuts = nested_thresholds(
        both, first, second, part_cols, sizes, lambda n: F.ceil(F.lit(0.5) * (n - sizes(n)).cast("double"))
    )
    if cuts is None:
        return _one_by_one(df, id_col, share, seed, part_cols, split_col)
    upto = lambda cols, thr: F.coalesce(order_key(cols) <= F.col(thr), F.lit(False))
    split = F.when(upto(first, "_thr1"), "val").when(upto(second, "_thr2"), "train2").otherwise("train1")
    return attach(both, cuts, part_cols).withColumn(split_col, split).drop("_key1", "_key2", "_thr1", "_thr2")


def _one_by_one(df, id_col, share, seed, part_cols, split_col):
    """The cuts of :func:`split_nested_halves` one after the other; validation rows come last in the second order."""
    first = _shuffled_head(df, id_col, seed, part_cols, lambda n: F.ceil(F.lit(share) * n.cast("double")), "_val")
    rest = F.when(F.col("_val"), 1).otherwise(0)
    keyed = first.withColumn("_rest", rest).withColumn("_key", seeded_key(f"{seed}:halves", id_col))
    # buckets of validation rows lie behind all others
    bucket = hash_bucket("_key") + F.col("_rest") * F.lit(16**HASH_DIGITS)

    def half(n):
        return F.ceil(F.lit(0.5) * (n - F.ceil(F.lit(share) * n.cast("double"))).cast("double"))

    flagged = head_flag(keyed, ["_rest", "_key", id_col], part_cols, bucket, half, "_second", break_ties=True)
    split = F.when(F.col("_val"), "val").when(F.col("_second"), "train2").otherwise("train1")
    return flagged.withColumn(split_col, split).drop("_val", "_rest", "_key", "_second")


def split_round_robin(
    df: DataFrame,
    order_cols: Sequence[str],
    part_cols: Sequence[str] = (),
    pattern: Sequence[str] = ("train",) * 7 + ("val",) * 2 + ("test",),
    split_col: str = "split",
    bucket=None,
) -> DataFrame:
    """Row index modulo ``len(pattern)`` picks the split (default 7 train, 2 val, 1 test)."""
    ranked = ordered_index(df, order_cols, part_cols, bucket=bucket)
    labels = F.array(*[F.lit(p) for p in pattern])
    return ranked.withColumn(
        split_col, F.element_at(labels, (F.pmod(F.col("_idx"), F.lit(len(pattern))) + 1).cast("int"))
    ).drop("_idx", "_n")


def split_prefix(
    df: DataFrame,
    text_col: str,
    order_cols: Sequence[str],
    share: float = 0.8,
    part_cols: Sequence[str] = (),
    split_col: str = "split",
    bucket=None,
) -> DataFrame:
    """The first ``int(share * total_chars)`` characters go to train, the rest to val.

    The document holding the cut is split inside its text; one output row per
    (document, split) piece. Only keys and lengths are ordered; the texts are compared with the key of that
    document, a row per partition. Equal keys are ordered by length and text; rows equal in all of these
    that lie on both sides of the cut cannot be told apart and raise an error. Null texts have no piece.
    """
    keys = [*order_cols, "_len", "_text"]
    rows = df.withColumns({"_len": F.length(text_col).cast("long"), "_text": F.xxhash64(text_col)}).where(F.col("_len").isNotNull())
    ranked = ordered_index(rows.select(*part_cols, *keys), keys, part_cols, bucket=bucket, weight="_len")
    cut = F.floor(F.lit(float(share)) * F.col("_total").cast("double")).cast("long")
    at = ranked.where((F.col("_start") <= cut) & (cut < F.col("_start") + F.col("_len")))
    key = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    cuts = materialise(at.select(*part_cols, key.alias("_cut_key"), (cut - F.col("_start")).alias("_left")), "prefix-cuts")
    if not attach(ranked, cuts, part_cols).where(key == F.col("_cut_key")).groupBy(*part_cols).count().where("count > 1").isEmpty():
        raise ValueError(TIED)
    rows = attach(rows, cuts, part_cols)
    text, left = F.col(text_col), F.col("_left").cast("int")

    def piece(name, part):
        return F.struct(F.lit(name).alias("name"), part.alias("part"))

    halves = F.array(piece("train", F.substring(text, F.lit(1), left)), piece("val", F.substring(text, left + 1, F.col("_len").cast("int"))))
    pieces = (
        F.when((key == F.col("_cut_key")) & (left > 0), halves)
        .when(F.coalesce(key >= F.col("_cut_key"), F.lit(False)), F.array(piece("val", text)))
        .otherwise(F.array(piece("train", text)))
    )
    cut_up = rows.withColumn("_piece", F.explode(pieces))
    others = [c for c in df.columns if c != text_col]
    return cut_up.select(*others, F.col("_piece.part").alias(text_col), F.col("_piece.name").alias(split_col))


def split_fraction(
    df: DataFrame,
    id_col: str,
    train_fraction: float,
    seed=DEFAULT_SEED,
    part_cols: Sequence[str] = (),
    split_col: str = "split",
) -> DataFrame:
    """Random split with exactly ``int(train_fraction * n)`` train rows (no row shuffle)."""
    f = float(train_fraction)
    flagged = _shuffled_head(
        df, id_col, seed, part_cols, lambda n: F.floor(F.lit(f) * n.cast("double")), "_train"
    )
    return flagged.withColumn(
        split_col, F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("val"))
    ).drop("_train")


__all__ = [
    "DEFAULT_SEED",
    "split_shuffled",
    "split_nested_halves",
    "split_round_robin",
    "split_prefix",
    "split_fraction",
]
