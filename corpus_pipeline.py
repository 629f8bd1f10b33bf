"""Training-data pipeline over ``documents``: identify, clean, deduplicate, mix and pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import langid
from corpusflow.llm.columns import passing
from corpusflow.llm.line_dedup import drop_boilerplate
from corpusflow.llm.packing import pack
from corpusflow.llm.queries import tokenizer_path
from corpusflow.llm.simhash import keep_one
from corpusflow.llm.source_mix import take_mix
from corpusflow.session import materialise, ship_package


#: Columns that stages read or change; any others pass through unchanged, whatever their names.
USED = ("doc_id", "text", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and far outliers go.

    Repeated rows share their fate; an empty table gives none.
    """
    ship_package(spark)
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


#: A line is boilerplate of a source above this part of its pages, on this many pages at least. Higher than the operator's
#: own, as near copies stand side by side until the next stage and must not lose their text before it.
LINE_RATIO, LINE_PAGES = 0.1, 5


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; every document stays.

    Copies of a text count as one page, so that they are left to the next stage instead of being emptied. Null
    sources are one source; null and empty texts stay as they are; ``n_chars`` follows a text that changes.
    """
    ship_package(spark)

    def run(rows: DataFrame) -> DataFrame:
        cleaned = drop_boilerplate(rows, "source", "text", LINE_RATIO, LINE_PAGES, count_copies=False)
        if "n_chars" in rows.columns:
            chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
            cleaned = cleaned.withColumn("n_chars", chars.cast(rows.schema["n_chars"].dataType))
        return cleaned.select(*rows.columns)

    return passing(docs, USED, run)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints differ in two bits or fewer.

    The least id stays, of repeated rows one; texts without a word (null ones too) are near duplicates of each other.
    """
    ship_package(spark)
    return keep_one(docs, words_per_shingle=3, distance=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weight takes them; those without a word are not taken.

    Null sources are one source, the last; ties and repeated rows are settled by id and text.
    """
    ship_package(spark)
    return take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its place in a sequence.

    Null and empty texts are their end token; repeated rows are documents of their own.
    """
    ship_package(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix),
    ("packing", pack_sequences),
]

#: Hashing, centroids and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
