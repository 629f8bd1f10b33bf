"""Site-relative line frequency: drop lines that stand on a large share of a host's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.columns import passing
from corpusflow.session import materialise

RATIO = 0.02
MIN_PAGES = 2  # a line on one page is not repeated, however small the host


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line, so that the shuffle carries no text."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def line_ratios(pages: DataFrame, host_col: str, text_col: str, count_copies: bool = True) -> DataFrame:
    """(host, line key, on_pages, pages) for every line with a non-blank character.

    A page counts once for a line that it repeats, and without ``count_copies`` pages of a host with the
    same text (128 bits of it) count as one. Counts are combined before the shuffle, so a frequent line
    or a large host costs each task a row or a few, and copies of a text a row a line.
    """
    own = F.array_distinct(F.transform(F.filter(_lines(text_col), lambda x: F.trim(x) != ""), _key))
    n = F.count(F.lit(1)) if count_copies else F.count_distinct("page")
    rows = pages.select(F.col(host_col).alias("host"), own.alias("lines"), _key(F.col(text_col)).alias("page"))
    seen = rows.select("host", "page", F.explode("lines").alias("line"))
    counts = seen.groupBy("host", "line").agg(n.alias("on_pages"))
    totals = materialise(rows.groupBy(F.col("host").alias("_host")).agg(n.alias("pages")), "line-hosts")
    counts = counts.where(F.col("on_pages") > 1)
    return counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")


def drop_boilerplate(
    pages: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    count_copies: bool = True,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_dropped``.

    A line is boilerplate on a host if it stands on at least ``min_pages`` of its pages and on more
    than ``ratio`` of them; by default on two, as a line that one page holds is not repeated. Lines are \\n-separated and compared exactly; blank lines never count and
    stay. Null hosts form one host; pages without text (null) count as pages and stay null with 0
    lines; a page that loses all its lines stays with an empty text. Repeated rows are pages of their
    own; without ``count_copies`` pages of a host with the same text count as one, so that copies do not
    make their whole text boilerplate. Other columns pass through, whatever their names, but for those called
    ``n_lines`` or ``n_dropped``, which are replaced. An empty table gives none.
    """
    pages = pages.drop("n_lines", "n_dropped")
    return passing(pages, (host_col, text_col), lambda p: _without(p, host_col, text_col, ratio, min_pages, count_copies))


def _without(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, count_copies: bool) -> DataFrame:
    frequent = line_ratios(pages, host_col, text_col, count_copies).where(
        (F.col("on_pages") >= min_pages) & (F.col("on_pages") > F.col("pages") * F.lit(ratio))
    )
    # At most (lines per page) / ratio lines of a host pass, so a host's list is bounded.
    lists = materialise(
        frequent.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_drop")), "line-lists"
    )
    rows = pages.join(lists, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    lines = _lines(text_col)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), _key(x)))
    hit = F.col("_drop").isNotNull() & F.col(text_col).isNotNull()
    rows = rows.withColumn("_kept", F.when(hit, kept))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(F.col("_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long")
    rows = rows.withColumns({"n_lines": n_lines, "n_dropped": n_dropped})
    text = F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).drop("_host", "_drop", "_kept")
