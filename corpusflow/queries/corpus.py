"""Queries over the document corpus: splits, tokenisers, token reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators.aggregates import (
    common_length_budget,
    domain_token_report,
    token_totals,
)
from corpusflow.operators.tokens import tokenize_char
from corpusflow.plans.catalog import corpus_catalog, documents_corpus
from corpusflow.queries import sql
from corpusflow.queries.registry import register
from corpusflow.session import input_version

CORPUS = f"corpus AS ({sql.documents_corpus()})"


def char_corpus(spark, base, domain_col="source"):
    return tokenize_char(documents_corpus(spark, base, domain_col))


def documents_version(spark, base) -> str:
    """Names the documents below ``base`` in cache keys."""
    return f"{base}:{input_version(spark, f'{base}/documents.parquet')}"


def tokens_of(spark, base):
    """The tokenised corpus, built once per application in the shared folder."""
    return corpus_catalog(spark, "documents_tokens", base)


@register(
    "domain_token_report",
    f"""WITH {CORPUS},
tok AS (SELECT split, domain, length({sql.char_clean('text')}) AS n FROM corpus)
SELECT split, CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain,
       count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM tok GROUP BY GROUPING SETS ((split, domain), (split))""",
)
def q_domain_token_report(spark, base):
    return domain_token_report(char_corpus(spark, base))


@register(
    "token_totals",
    f"""WITH {CORPUS}
SELECT split, count(*) AS n_docs, CAST(sum(length({sql.char_clean('text')})) AS BIGINT) AS n_tokens
FROM corpus GROUP BY split""",
)
def q_token_totals(spark, base):
    return token_totals(char_corpus(spark, base))


@register(
    "common_length_budget",
    f"""WITH {CORPUS},
per AS (SELECT split, domain, sum(length({sql.char_clean('text')})) AS t FROM corpus GROUP BY split, domain)
SELECT split, CAST(min(t) AS BIGINT) AS budget FROM per GROUP BY split""",
)
def q_common_length_budget(spark, base):
    return common_length_budget(char_corpus(spark, base))


@register(
    "split_shuffled",
    f"""WITH {CORPUS}
SELECT doc_id, domain, split FROM corpus""",
)
def q_split_shuffled(spark, base):
    return documents_corpus(spark, base).select("doc_id", "domain", "split")


@register(
    "tokenize_char",
    f"""WITH {CORPUS},
t AS ({sql.char_tokens('corpus')})
SELECT d.doc_id, CAST(length({sql.char_clean('d.text')}) AS BIGINT) AS n_tokens,
       CAST(coalesce(sum((t.i + 1) * (t.id + 1)), 0) AS BIGINT) AS checksum
FROM corpus d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id, d.text""",
)
def q_tokenize_char(spark, base):
    from corpusflow.functions.arrow import ids_stats

    tok = char_corpus(spark, base)
    return tok.select("doc_id", ids_stats(F.col("ids")).alias("s")).select(
        "doc_id", "s.n_tokens", "s.checksum"
    )
