"""Queries over sources and sinks. Each writes data Spark derives from the given
tables to the shared scratch folder, then reads it back through the reader
under test, so the work grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators.domains import filter_domain, normalise_domain, strip_markup
from corpusflow.operators.mixing import rebase
from corpusflow.operators.packing import block_summary, count_tokens, shard_contiguous
from corpusflow.operators.splits import split_shuffled
from corpusflow.plans.catalog import corpus_catalog, documents_corpus, table
from corpusflow.queries import sql
from corpusflow.queries.corpus import CORPUS, char_corpus
from corpusflow.queries.mixes import blocks_of
from corpusflow.queries.registry import register
from corpusflow.queries.streams import BLOCK, PART, TOK_DOCS, TOKENS
from corpusflow.session import scratch_path
from corpusflow.sources.readers import (
    read_archives,
    read_jsonl_corpus,
    read_jsonl_glob,
    read_split_table,
    read_table_corpus,
    read_whole_files,
    read_year_partitions,
)
from corpusflow.sources.sinks import materialise_once, write_archives, write_jsonl, write_token_bin
from corpusflow.sources.tokens import read_token_stream
from corpusflow.functions.text import strip_markup_sql

FILE_BLOCKS = 64  # blocks per token file: 32k tokens

DOC_JSON_SCHEMA = (
    "doc_id BIGINT, text STRING, meta STRUCT<lang: STRING, source: STRING, n_chars: BIGINT>"
)


def _docs_with_meta(spark, base):
    d = table(spark, base, "documents")
    return d.select("doc_id", "text", F.struct("lang", "source", "n_chars").alias("meta"))


@register(
    "read_jsonl_corpus",
    "SELECT source AS domain, doc_id, text FROM documents",
)
def q_read_jsonl_corpus(spark, base):
    root = scratch_path(spark, "jsonl-by-domain")
    _docs_with_meta(spark, base).withColumn("dom", F.col("meta.source")).write.partitionBy("dom").json(root)
    corpus = read_jsonl_corpus(spark, f"{root}/dom=*", DOC_JSON_SCHEMA, keep=["doc_id"], domain=r"dom=([^/]*)")
    return corpus.select("domain", "doc_id", "text")


@register(
    "read_jsonl_glob",
    "SELECT doc_id, text, lang FROM documents",
)
def q_read_jsonl_glob(spark, base):
    root = scratch_path(spark, "jsonl-glob")
    _docs_with_meta(spark, base).withColumn("lang", F.col("meta.lang")).write.partitionBy("lang").json(
        f"{root}/cc_2019-30"
    )
    bench = table(spark, base, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    bench.write.json(f"{root}/book_sample")
    schema = DOC_JSON_SCHEMA + ", lang STRING"
    return read_jsonl_glob(spark, root, "cc_20", schema).select("doc_id", "text", "lang")


@register(
    "read_split_table",
    f"""SELECT {sql.split_case(2357, 0.05, 'doc_id', '1', ('train', 'val'))} AS split, doc_id, source AS set_name FROM documents""",
)
def q_read_split_table(spark, base):
    root = scratch_path(spark, "split-table")
    docs = _docs_with_meta(spark, base)
    split = split_shuffled(docs, "doc_id", 0.05, 2357, names=("train", "test"))
    split.write.partitionBy("split").parquet(root)
    t = read_split_table(spark, {"train": f"{root}/split=train", "test": f"{root}/split=test"})
    return t.select("split", "doc_id", F.col("meta.source").alias("set_name"))


@register(
    "read_table_corpus",
    "SELECT page_id, html AS text FROM pages",
)
def q_read_table_corpus(spark, base):
    return read_table_corpus(spark, f"{base}/pages.parquet", "html", keep=["page_id"])


@register(
    "read_whole_files",
    f"""WITH {CORPUS} SELECT split, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM corpus GROUP BY split""",
)
def q_read_whole_files(spark, base):
    root = scratch_path(spark, "whole-files")
    documents_corpus(spark, base).select("split", "text").write.partitionBy("split").text(root)
    files = read_whole_files(spark, {"train": f"{root}/split=train/*.txt", "val": f"{root}/split=val/*.txt"})
    return files.groupBy("split").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))


@register(
    "read_archives",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents",
)
def q_read_archives(spark, base):
    root = scratch_path(spark, "archives")
    docs = table(spark, base, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text"
    )
    write_archives(docs, root, "name", "text", max_members=200).count()  # runs the writes
    members = read_archives(spark, f"{root}/*.tar.gz")
    return members.select(
        F.regexp_extract("member", r"^(\d+)\.txt$", 1).cast("long").alias("doc_id"),
        F.length("content").cast("long").alias("n_chars"),
        F.md5("content").alias("text_md5"),
    )


@register(
    "read_year_partitions",
    """SELECT CAST(1991 + ntile(12) OVER (ORDER BY doc_id) AS INTEGER) AS year, doc_id,
  CAST(ntile(12) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS year_order FROM documents""",
)
def q_read_year_partitions(spark, base):
    root = scratch_path(spark, "years")
    docs = table(spark, base, "documents").select("doc_id", "text")
    papers = shard_contiguous(docs, 12, ["doc_id"], shard_col="shard").withColumn(
        "year", (F.col("shard") + 1992).cast("int")
    )
    papers.drop("shard").write.partitionBy("year").parquet(root)
    return read_year_partitions(spark, root).select("year", "doc_id", "year_order")


def _bin_positions():
    return f"WITH {CORPUS}, pos AS ({sql.stream_positions(TOKENS, TOK_DOCS, PART)})"


@register(
    "read_token_bin",
    f"""{_bin_positions()} {sql.block_summary('SELECT * FROM pos', PART, BLOCK)}""",
)
def q_read_token_bin(spark, base):
    root = scratch_path(spark, "token-bin")
    blocks = blocks_of(spark, base)
    manifest = write_token_bin(blocks, root, BLOCK, blocks_per_file=FILE_BLOCKS)
    pieces = read_token_stream(spark, root, piece_len=BLOCK).withColumnRenamed("pos", "offset")
    return block_summary(rebase(pieces, BLOCK, PART, count_tokens(manifest)), PART)


@register(
    "write_token_bin",
    f"""{_bin_positions()}
SELECT split, domain, CAST(pos // {BLOCK * FILE_BLOCKS} AS BIGINT) AS file_id, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n_tokens
FROM pos GROUP BY split, domain, pos // {BLOCK * FILE_BLOCKS}""",
)
def q_write_token_bin(spark, base):
    root = scratch_path(spark, "token-bin-manifest")
    blocks = blocks_of(spark, base)
    manifest = write_token_bin(blocks, root, BLOCK, blocks_per_file=FILE_BLOCKS)
    return manifest.drop("file")


@register(
    "write_jsonl",
    "SELECT doc_id, text, lang, source FROM documents",
)
def q_write_jsonl(spark, base):
    root = scratch_path(spark, "write-jsonl")
    write_jsonl(_docs_with_meta(spark, base), root)
    back = spark.read.schema(DOC_JSON_SCHEMA).json(root)
    return back.select("doc_id", "text", F.col("meta.lang").alias("lang"), F.col("meta.source").alias("source"))


@register(
    "materialise_once",
    f"""WITH {CORPUS} SELECT split, domain, doc_id, CAST(length({sql.char_clean('text')}) AS BIGINT) AS n_tokens FROM corpus""",
)
def q_materialise_once(spark, base):
    path = scratch_path(spark, "materialised")

    def build():
        return char_corpus(spark, base).select("split", "domain", "doc_id", "n_tokens")

    materialise_once(build, path, spark)  # builds
    return materialise_once(build, path, spark)  # second call only loads


@register(
    "corpus_catalog",
    f"""WITH {CORPUS}, b AS (SELECT item_id AS doc_id, 'benchmark' AS domain,
  {sql.split_case(2357, 0.1, 'item_id', 'domain')} AS split FROM benchmark)
SELECT split, domain, count(*) AS n_docs FROM (SELECT split, domain, doc_id FROM corpus UNION ALL SELECT split, domain, doc_id FROM b)
GROUP BY split, domain""",
)
def q_corpus_catalog(spark, base):
    corpus = corpus_catalog(spark, "documents+benchmark", base)
    return corpus.groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n_docs"))


@register(
    "filter_domain",
    "SELECT doc_id, n_chars FROM documents WHERE source = (SELECT min(source) FROM documents)",
)
def q_filter_domain(spark, base):
    root = scratch_path(spark, "nested-meta")
    table(spark, base, "documents").select(
        "doc_id", "text", F.struct(F.col("source").alias("set_name"), "n_chars").alias("meta")
    ).write.parquet(root)
    first = table(spark, base, "documents").agg(F.min("source")).first()[0]
    nested = spark.read.parquet(root)
    return filter_domain(nested, "meta.set_name", first).select(
        "doc_id", F.col("meta.n_chars").alias("n_chars")
    )


@register(
    "normalise_domain",
    "SELECT doc_id, replace(source || '_' || lang, '_', ' ') AS domain_name, false AS unmatched FROM documents",
)
def q_normalise_domain(spark, base):
    docs = table(spark, base, "documents").select(
        "doc_id", F.concat_ws("_", "source", "lang").alias("short")
    )
    return normalise_domain(docs, "short", underscores_to_spaces=True).select(
        "doc_id", "domain_name", "unmatched"
    )


@register(
    "strip_markup",
    f"SELECT page_id, md5({strip_markup_sql('html', 'html')}) AS text_md5, "
    f"CAST(length({strip_markup_sql('html', 'html')}) AS BIGINT) AS n_chars FROM pages",
)
def q_strip_markup(spark, base):
    pages = strip_markup(table(spark, base, "pages"), "html", "html")
    return pages.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


#: A paper around each document: comment, section, environment, emphasis, formulas, a figure, a label, references.
_PAPER = (
    "\\documentclass{article} % draft\n\\begin{document}\n\\section*{",
    "}\n\\emph{",
    "} costs 5\\% of $x^2$ and $$y = z$$\n",
    "\n\\begin{figure*}[h]\n\\includegraphics{a.png}\n\\caption{A figure}\n\\end{figure*}\n"
    "\\label{sec:end} See~\\cite[p. 3]{key} and \\ref{sec:end} \\alpha\n% end\n\\end{document}\n",
)
_PAPER_SQL = (
    f"('{_PAPER[0]}' || source || '{_PAPER[1]}' || lang || '{_PAPER[2]}' || text || '{_PAPER[3]}')"
)


@register(
    "strip_markup_latex",
    f"SELECT doc_id, md5({strip_markup_sql(_PAPER_SQL, 'latex')}) AS text_md5, "
    f"CAST(length({strip_markup_sql(_PAPER_SQL, 'latex')}) AS BIGINT) AS n_chars FROM documents",
)
def q_strip_markup_latex(spark, base):
    a, b, c, d = (F.lit(x) for x in _PAPER)
    papers = table(spark, base, "documents").select("doc_id", F.concat(a, "source", b, "lang", c, "text", d).alias("tex"))
    out = strip_markup(papers, "tex", "latex")
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


LANGUAGES = {"en": "English", "de": "German", "fr": "French"}


@register(
    "normalise_domain_mapped",
    "SELECT doc_id, CASE lang "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
    + f" ELSE lang END AS domain_name, lang NOT IN {tuple(LANGUAGES)} AS unmatched FROM documents",
)
def q_normalise_domain_mapped(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "lang")
    return normalise_domain(docs, "lang", LANGUAGES).select("doc_id", "domain_name", "unmatched")
