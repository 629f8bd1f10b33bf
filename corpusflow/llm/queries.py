"""Registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import conversation, langid, toxicity
from corpusflow.llm.embedding import near_vectors
from corpusflow.llm.hmm import score_texts
from corpusflow.llm.line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from corpusflow.llm.packing import pack
from corpusflow.llm.repetition import repetition_rules
from corpusflow.llm.rtree import mine
from corpusflow.llm.sharding import minimax_shards
from corpusflow.llm.simhash import near_duplicates
from corpusflow.llm.source_mix import mix_sources
from corpusflow.llm.warc import archive_pages


def tokenizer_path() -> str:
    """The public tokenizer file that the packing query names; its place is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def in_fold(divisor: int, rest: int):
    """crc32 of the id as text, modulo ``divisor``, is ``rest``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose sizes are near equal, equal texts together."""
    shards = minimax_shards(_table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens."""
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path(), cache_entries=900_000, slice_bytes=2_000_000)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words_per_shingle=3, distance=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(in_fold(5, 0), F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    cleaned = drop_boilerplate(_table(spark, sf_dir, "documents"), "source", "text")
    return cleaned.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records with revisits, read back and resolved."""
    return archive_pages(_table(spark, sf_dir, "pages"))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(in_fold(3, 1), F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.classify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weight takes of every document."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    damaged = conversation.damage(_table(spark, sf_dir, "conversations"))
    return conversation.summarise(conversation.repair(damaged, "copies"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document, learned from documents outside the held-out fold."""
    held_out = F.coalesce(in_fold(7, 2), F.lit(False))
    scored = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, for each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_repetition,
        op3_packing,
        op4_simhash,
        op5_toxicity,
        op6_line_dedup,
        op7_warc,
        op8_embedding,
        op9_langid,
        op10_source_mix,
        op11_conversation,
        op12_language_model,
        op13_hard_negatives,
    )
}

ORACLES = {
    "op6_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents),
        hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
        boilerplate AS (
            SELECT l.source, line
            FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
            WHERE trim(line) <> ''
            GROUP BY l.source, line
            HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > max(pages) * {RATIO}),
        marked AS (
            SELECT l.*, b.line IS NOT NULL AS dropped
            FROM lines l LEFT JOIN boilerplate b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
        joined AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, d.source, CASE WHEN j.n_dropped > 0 THEN j.text ELSE d.text END AS text,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
        FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        o AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN o ON p.html = o.html""",
    "op10_source_mix": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5(concat_ws(':', '17', doc_id::VARCHAR)) AS key, md5(text) AS tie
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
                   list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w
            FROM d GROUP BY source),
        rounds AS (
            SELECT 0 AS n, (SELECT sum(source_size)::DOUBLE / sum(w) FROM s) AS level
            UNION ALL
            SELECT n + 1, (SELECT (sum(source_size)::DOUBLE - coalesce(sum(cap) FILTER (w * level > cap), 0)) / sum(w) FILTER (w * level <= cap) FROM s)
            FROM rounds WHERE n < 30),
        t AS (SELECT source, source_size, least(w * (SELECT max(level) FROM rounds), cap) AS target FROM s),
        o AS (
            SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                   (sum(size) OVER (PARTITION BY d.source ORDER BY key, tie NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE
                   size * (budget // source_size)
                   + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) END::BIGINT AS taken
        FROM o""",
    "op11_conversation": r"""
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tbl),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(
                        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                        lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) % 20 AS kind
                  FROM conversations, bits)),
        ordered AS (
            SELECT *, row_number() OVER w AS i, left(role, 1) AS c, lag(left(role, 1)) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        rows AS (
            SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                           WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM ordered),
        moves(state, c, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(state, letters, price, after) AS (
            SELECT DISTINCT state, '', 0, state FROM moves
            UNION ALL SELECT state, 'I', 2, after FROM moves WHERE c <> 's'
            UNION ALL SELECT a.state, 'II', 4, b.after FROM moves a JOIN moves b ON a.after = b.state WHERE a.c <> 's' AND b.c <> 's'),
        steps AS (
            SELECT state, state AS after, 'any' AS c, 'D' AS letters, 3 AS price FROM inserts WHERE letters = ''
            UNION ALL SELECT i.state, m.after, m.c, i.letters || 'K', i.price FROM inserts i JOIN moves m ON i.after = m.state
            UNION ALL SELECT i.state, m.after, 'stays', i.letters || 'R', i.price + 2 FROM inserts i JOIN moves m ON i.after = m.state WHERE m.c <> 's'),
        paths AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM conversations
            UNION ALL
            SELECT conv_id, i, state, cost, audit FROM (
                SELECT p.conv_id, r.i, s.after AS state, p.cost + s.price + CASE WHEN s.c <> 'any' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
                       p.audit || s.letters AS audit,
                       row_number() OVER (PARTITION BY p.conv_id, s.after ORDER BY p.cost + s.price
                           + CASE WHEN s.c <> 'any' AND fault = 'truncated' THEN 1 ELSE 0 END, p.audit || s.letters) AS nth
                FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
                JOIN steps s ON s.state = p.state AND (s.c = 'any' OR fault NOT IN ('blank', 'duplicate') AND s.c IN ('stays', r.c)))
            WHERE nth = 1),
        best AS (
            SELECT conv_id, cost, audit FROM (
                SELECT p.conv_id, p.cost + i.price AS cost, p.audit || i.letters AS audit,
                       row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + i.price, p.audit || i.letters) AS nth
                FROM paths p JOIN inserts i ON p.state = i.state AND i.after IN (0, 3)
                WHERE p.i = (SELECT count(*) FROM rows r WHERE r.conv_id IS NOT DISTINCT FROM p.conv_id))
            WHERE nth = 1),
        letters AS (
            SELECT conv_id, k, letter, CASE WHEN letter <> 'I' THEN count(*) FILTER (letter <> 'I') OVER w END AS i,
                   count(*) FILTER (letter <> 'D') OVER w AS place
            FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS k FROM best WHERE audit <> '')
            WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        kept AS (
            SELECT l.*, r.role, r.text, coalesce(max(CASE WHEN letter = 'K' AND r.c = 's' THEN 1 END) OVER (PARTITION BY l.conv_id), 0) AS opened
            FROM letters l LEFT JOIN rows r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i),
        texts AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
                       || ':' || coalesce(text, ''), chr(10) ORDER BY k) FILTER (letter <> 'D') AS repaired
            FROM kept GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
            FROM rows GROUP BY conv_id)
        SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost, b.audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON b.conv_id IS NOT DISTINCT FROM t.conv_id""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT uid, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS nth
            FROM scores WHERE same),
        ranked AS (
            SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY s.uid, nth ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM scores s JOIN positives p ON s.uid = p.uid
            WHERE nth <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
}
