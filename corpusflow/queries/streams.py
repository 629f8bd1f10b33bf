"""Queries over token streams: offsets, shards, blocks, tails, BPE and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators.packing import (
    block_summary,
    concat_shard,
    context_tail,
    pack_blocks,
    shard_contiguous,
    token_offsets,
)
from corpusflow.operators.splits import (
    split_fraction,
    split_nested_halves,
    split_prefix,
    split_round_robin,
)
from corpusflow.operators.tokens import detokenize, tokenize_bpe, tokenize_raw
from corpusflow.plans.catalog import documents_corpus, table
from corpusflow.queries import sql
from corpusflow.queries.corpus import CORPUS, char_corpus, tokens_of
from corpusflow.queries.registry import register

BLOCK = 512
SHARDS = 10
TAIL = 64
PART = ["split", "domain"]

TOK_DOCS = f"SELECT split, domain, doc_id, length({sql.char_clean('text')}) AS n FROM corpus"
TOKENS = sql.char_tokens("corpus")


def ids_checksum(col="ids"):
    """Positional checksum sum((i+1)*(id+1)) of an id array (Arrow batch kernel)."""
    from corpusflow.functions.arrow import ids_stats

    return ids_stats(F.col(col))["checksum"]


@register(
    "token_offsets",
    f"""WITH {CORPUS}, d AS ({TOK_DOCS})
SELECT split, domain, doc_id, CAST(n AS BIGINT) AS n_tokens,
  CAST(coalesce(sum(n) OVER (PARTITION BY split, domain ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
  CAST(sum(n) OVER (PARTITION BY split, domain) AS BIGINT) AS stream_len
FROM d""",
)
def q_token_offsets(spark, base):
    tok = char_corpus(spark, base).drop("ids", "text")
    return token_offsets(tok, PART, ["doc_id"]).select(
        "split", "domain", "doc_id", "n_tokens", "offset", "stream_len"
    )


@register(
    "shard_contiguous",
    f"""WITH {CORPUS}
SELECT split, domain, doc_id, CAST(ntile({SHARDS}) OVER (PARTITION BY split, domain ORDER BY doc_id) - 1 AS BIGINT) AS shard
FROM corpus""",
)
def q_shard_contiguous(spark, base):
    docs = documents_corpus(spark, base).select("split", "domain", "doc_id")
    return shard_contiguous(docs, SHARDS, ["doc_id"], PART)


_SHARDED = f"""sh AS (SELECT split, domain, doc_id, text,
  ntile({SHARDS}) OVER (PARTITION BY split, domain ORDER BY doc_id) - 1 AS shard FROM corpus)"""


@register(
    "concat_shard",
    f"""WITH {CORPUS}, {_SHARDED},
pos AS ({sql.stream_positions(
        sql.char_tokens('sh').replace('SELECT split, domain,', 'SELECT split, domain, shard,').replace(
            'FROM (SELECT split, domain,', 'FROM (SELECT split, domain, shard,'),
        f"SELECT split, domain, shard, doc_id, length({sql.char_clean('text')}) AS n FROM sh",
        ['split', 'domain', 'shard'])})
{sql.block_summary('SELECT * FROM pos', ['split', 'domain', 'shard'], 1 << 16)}""",
)
def q_concat_shard(spark, base):
    tok = tokens_of(spark, base)
    sharded = shard_contiguous(tok, SHARDS, ["doc_id"], PART)
    pieces = concat_shard(sharded, "shard", ["doc_id"], part_cols=PART)
    return block_summary(pieces, [*PART, "shard"])


@register(
    "pack_blocks",
    f"""WITH {CORPUS}, pos AS ({sql.stream_positions(TOKENS, TOK_DOCS, PART)})
{sql.block_summary('SELECT * FROM pos', PART, BLOCK)}""",
)
def q_pack_blocks(spark, base):
    tok = tokens_of(spark, base)
    return block_summary(pack_blocks(tok, BLOCK, PART, ["doc_id"]), PART)


@register(
    "context_tail",
    f"""WITH {CORPUS}, t AS ({TOKENS}), d AS ({TOK_DOCS})
SELECT d.doc_id, CAST(count(t.id) AS BIGINT) AS n_tokens,
  CAST(coalesce(sum((t.i - greatest(d.n - {TAIL}, 0) + 1) * (t.id + 1)), 0) AS BIGINT) AS checksum
FROM d LEFT JOIN t ON d.doc_id = t.doc_id AND t.i >= d.n - {TAIL}
GROUP BY d.doc_id, d.n""",
)
def q_context_tail(spark, base):
    tok = context_tail(tokens_of(spark, base), "ids", TAIL, "tail")
    return tok.select(
        "doc_id", F.size("tail").cast("long").alias("n_tokens"), ids_checksum("tail").alias("checksum")
    )


def _ids_md5(col="ids"):
    from corpusflow.functions.arrow import ids_md5

    return ids_md5(F.col(col))


@register(
    "tokenize_bpe",
    f"""SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_tokens,
  {sql.bytes_md5('text', True)} AS ids_md5 FROM documents""",
)
def q_tokenize_bpe(spark, base):
    docs = table(spark, base, "documents", spread_on="doc_id").select("doc_id", "text")
    return tokenize_bpe(docs).select("doc_id", "n_tokens", _ids_md5().alias("ids_md5"))


@register(
    "tokenize_raw",
    f"""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_tokens,
  {sql.bytes_md5('text', False)} AS ids_md5 FROM documents""",
)
def q_tokenize_raw(spark, base):
    docs = table(spark, base, "documents", spread_on="doc_id").select("doc_id", "text")
    return tokenize_raw(docs, special="ordinary").select("doc_id", "n_tokens", _ids_md5().alias("ids_md5"))


@register(
    "detokenize",
    f"""SELECT doc_id, md5({sql.char_clean('text')}) AS text_md5 FROM documents""",
)
def q_detokenize(spark, base):
    from corpusflow.operators.tokens import tokenize_char

    docs = tokenize_char(table(spark, base, "documents", spread_on="doc_id").select("doc_id", "text"))
    return detokenize(docs.drop("text"), "ids", "char").select(
        "doc_id", F.md5("text").alias("text_md5")
    )


@register(
    "split_nested_halves",
    f"""WITH {CORPUS}, tr AS (SELECT doc_id, domain, {sql.split_case('2357:halves', 0.5, 'doc_id', 'domain', ('train1', 'train2'))} AS split
  FROM corpus WHERE split = 'train')
SELECT doc_id, domain, split FROM tr UNION ALL SELECT doc_id, domain, split FROM corpus WHERE split = 'val'""",
)
def q_split_nested_halves(spark, base):
    docs = table(spark, base, "documents").select("doc_id", F.col("source").alias("domain"))
    return split_nested_halves(docs, "doc_id", 0.05, 2357, ["domain"]).select("doc_id", "domain", "split")


@register(
    "split_round_robin",
    """SELECT doc_id, source AS domain,
  CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 < 7 THEN 'train'
       WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 < 9 THEN 'val' ELSE 'test' END AS split
FROM documents""",
)
def q_split_round_robin(spark, base):
    docs = table(spark, base, "documents").select("doc_id", F.col("source").alias("domain"))
    return split_round_robin(docs, ["doc_id"], ["domain"])


@register(
    "split_prefix",
    """WITH d AS (SELECT doc_id, lang, text, length(text) AS n,
  coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  floor(CAST(0.8 AS DOUBLE) * sum(length(text)) OVER (PARTITION BY lang)) AS cut FROM documents),
p AS (SELECT doc_id, lang, 'train' AS split, CASE WHEN cut - s >= n THEN text ELSE substr(text, 1, CAST(cut - s AS BIGINT)) END AS piece FROM d WHERE s < cut
  UNION ALL
  SELECT doc_id, lang, 'val' AS split, CASE WHEN cut - s <= 0 THEN text ELSE substr(text, CAST(cut - s + 1 AS BIGINT)) END AS piece FROM d WHERE s + n > cut)
SELECT doc_id, lang, split, CAST(length(piece) AS BIGINT) AS n_chars, md5(piece) AS piece_md5 FROM p""",
)
def q_split_prefix(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "lang", "text")
    out = split_prefix(docs, "text", ["doc_id"], 0.8, ["lang"])
    return out.select(
        "doc_id", "lang", "split", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("piece_md5")
    )


@register(
    "split_fraction",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql.md5_key(2357, 'doc_id')}, doc_id) - 1
  < floor(CAST(0.5 AS DOUBLE) * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM documents""",
)
def q_split_fraction(spark, base):
    docs = table(spark, base, "documents").select("doc_id")
    return split_fraction(docs, "doc_id", 0.5, 2357)

