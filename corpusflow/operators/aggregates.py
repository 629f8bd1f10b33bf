"""Token counts per split and domain (partial + final hash aggregates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "all"


def token_totals(tok_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Total tokens (and documents) per split."""
    return tok_df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens")
    )


def domain_token_report(
    tok_df: DataFrame, split_col: str = "split", domain_col: str = "domain"
) -> DataFrame:
    """Tokens per (split, domain) plus one ``all`` line per split.

    One aggregation with grouping sets ((split, domain), (split)): the rows are
    read and partially aggregated once, not once per domain.
    """
    g = tok_df.groupingSets([[split_col, domain_col], [split_col]], split_col, domain_col).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").cast("long").alias("n_tokens"),
        F.grouping(domain_col).alias("_g"),
    )
    return g.select(
        split_col,
        F.when(F.col("_g") == 1, F.lit(ALL)).otherwise(F.col(domain_col)).alias(domain_col),
        "n_docs",
        "n_tokens",
    )


def common_length_budget(
    tok_df: DataFrame,
    domains: Sequence[str] | None = None,
    split_col: str = "split",
    domain_col: str = "domain",
) -> DataFrame:
    """Per split, the smallest token total over the chosen domains."""
    df = tok_df if domains is None else tok_df.where(F.col(domain_col).isin(list(domains)))
    per_domain = df.groupBy(split_col, domain_col).agg(F.sum("n_tokens").alias("_t"))
    return per_domain.groupBy(split_col).agg(F.min("_t").cast("long").alias("budget"))


def sample_counts(sample_df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """How many draws each domain received."""
    return sample_df.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_samples"))
