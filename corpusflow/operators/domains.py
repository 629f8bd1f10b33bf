"""Domain labels and markup: nested-field filters, name normalisation, markup stripping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import strip_markup_expr

# Stored set names of the seven-domain web corpus, and the raw
# subset name that differs from its short name.
REDPAJAMA_SET_NAMES = {
    "arxiv": "RedPajamaArXiv",
    "book": "RedPajamaBook",
    "cc": "RedPajamaCommonCrawl",
    "c4": "RedPajamaC4",
    "github": "RedPajamaGithub",
    "stackexchange": "RedPajamaStackExchange",
    "wikipedia": "RedPajamaWikipedia",
}
RAW_SUBSET_NAMES = {"cc": "common_crawl"}


def filter_domain(df: DataFrame, field: str, value: str) -> DataFrame:
    """Rows whose (possibly nested) metadata field equals ``value``; pushed to the Parquet scan."""
    return df.where(F.col(field) == F.lit(value))


def normalise_domain(
    df: DataFrame,
    col: str,
    mapping: dict[str, str] | None = None,
    underscores_to_spaces: bool = False,
    out_col: str = "domain_name",
) -> DataFrame:
    """Short names -> stored names.

    ``underscores_to_spaces`` turns ``Wikipedia_(en)`` into ``Wikipedia (en)``;
    ``mapping`` is a small literal map (a lookup, no join); names missing from
    the mapping are kept and flagged in ``unmatched``.
    """
    name = F.col(col)
    if underscores_to_spaces:
        name = F.translate(name, "_", " ")
    unmatched = F.lit(False)
    if mapping:
        lit_map = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        looked = F.try_element_at(lit_map, name)
        unmatched = looked.isNull()
        name = F.coalesce(looked, name)
    return df.withColumn(out_col, name).withColumn("unmatched", unmatched)


def strip_markup(df: DataFrame, col: str, dialect: str = "html", out_col: str = "text") -> DataFrame:
    """LaTeX or HTML -> plain text as a native regex chain (no external converter, no UDF)."""
    return df.withColumn(out_col, strip_markup_expr(F.col(col), dialect))
