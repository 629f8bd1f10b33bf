"""Queries over block tables: concatenation, carving, shuffles, noise, mixtures, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.operators.aggregates import common_length_budget, sample_counts
from corpusflow.operators.mixing import (
    carve_tail,
    concat_domains,
    head_blocks,
    mix_by_rate,
    noise_tokens,
    resample_spans,
    shuffle_blocks,
    stream_lengths,
    train_one_eval_all,
)
from corpusflow.operators.packing import block_summary, pack_blocks
from corpusflow.operators.sampling import (
    batch_schedule,
    draw_domains,
    epoch_batches,
    epochs_needed,
    sample_domains_weighted,
    sample_windows,
    sample_with_domain_ids,
    window_starts,
)
from corpusflow.operators.splits import split_fraction
from corpusflow.plans.catalog import documents_corpus, table
from corpusflow.queries import sql
from corpusflow.queries.corpus import CORPUS, documents_version, tokens_of
from corpusflow.queries.registry import register
from corpusflow.queries.streams import BLOCK, PART, TOK_DOCS, TOKENS, ids_checksum
from corpusflow.session import cached_path, session_cached
from corpusflow.sources.blockstore import block_store_once

SEQ = 128
HEAD = 4
#: Blocks of each stream that go to the mixture, by split, as in the reference: 2 * 10**9 training tokens of seven domains.
CARVE = {"train": 2_000_000_000 // BLOCK // 7, "val": 2000}
CTX_RESAMPLE = 100
CTX_MIX = 1000

POS = f"{CORPUS}, pos AS ({sql.stream_positions(TOKENS, TOK_DOCS, PART)}), " \
      "lens AS (SELECT split, domain, count(*) AS T FROM pos GROUP BY split, domain)"
BUDGET = (f"budget AS (SELECT split, CAST(min(t) AS BIGINT) AS n FROM (SELECT split, domain, sum(length({sql.char_clean('text')})) AS t "
          "FROM corpus GROUP BY split, domain) GROUP BY split)")


def summary(positions: str, part=PART, block=BLOCK) -> str:
    return sql.block_summary(positions, part, block)


def store_of(spark, base):
    """The block store of the corpus, built once per application: operators read it for lengths, windows and data."""
    path = cached_path(spark, f"blocks:{documents_version(spark, base)}:{BLOCK}")
    return block_store_once(lambda: pack_blocks(tokens_of(spark, base), BLOCK, PART, ["doc_id"]), path, spark, BLOCK, in_order=True)


def blocks_of(spark, base):
    """The block table of the store."""
    return store_of(spark, base).blocks()


@register(
    "concat_domains",
    f"""WITH {POS},
b AS (SELECT split, domain, coalesce(sum(T) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lens),
ap AS (SELECT p.split, 'all' AS domain, p.id, p.pos + b.base AS pos FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain)
{summary('SELECT * FROM ap')}""",
)
def q_concat_domains(spark, base):
    tok = tokens_of(spark, base)
    return block_summary(concat_domains(tok, BLOCK), PART)


@register(
    "train_one_eval_all",
    f"""WITH {CORPUS}
SELECT split, domain, doc_id FROM corpus
WHERE (split = 'train' AND domain = (SELECT min(source) FROM documents)) OR split = 'val'""",
)
def q_train_one_eval_all(spark, base):
    corpus = documents_corpus(spark, base)
    first = table(spark, base, "documents").agg(F.min("source")).first()[0]
    return train_one_eval_all(corpus, first).select("split", "domain", "doc_id")


@register(
    "head_blocks",
    f"""WITH {POS}
{summary(f"SELECT * FROM pos WHERE split = 'val' AND pos < {HEAD * BLOCK}")}""",
)
def q_head_blocks(spark, base):
    blocks = blocks_of(spark, base).where(F.col("split") == "val")
    return block_summary(head_blocks(blocks, HEAD), PART)


@register(
    "carve_tail",
    f"""WITH {POS},
c AS (SELECT split, domain, cut, T - cut AS tail FROM (SELECT split, domain, T,
  greatest(T - CASE split WHEN 'train' THEN {CARVE['train'] * BLOCK} ELSE {CARVE['val'] * BLOCK} END, 0) AS cut FROM lens)),
b AS (SELECT *, coalesce(sum(tail) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c),
np AS (SELECT p.split, p.domain, p.id, p.pos FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain WHERE p.pos < b.cut
  UNION ALL
  SELECT p.split, 'mix' AS domain, p.id, b.base + p.pos - b.cut AS pos FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain WHERE p.pos >= b.cut)
{summary('SELECT * FROM np')}""",
)
def q_carve_tail(spark, base):
    return block_summary(carve_tail(blocks_of(spark, base), BLOCK, CARVE), PART)


@register(
    "shuffle_blocks",
    f"""WITH {POS},
bk AS (SELECT split, domain, pos // {BLOCK} AS block_id, count(*) AS sz FROM pos GROUP BY ALL),
ns AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY split, domain ORDER BY {sql.md5_key(7, 'split', 'domain', 'block_id')}, block_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS noff FROM bk),
np AS (SELECT p.split, p.domain, p.id, ns.noff + p.pos - ns.block_id * {BLOCK} AS pos FROM pos p JOIN ns
  ON p.split = ns.split AND p.domain = ns.domain AND p.pos // {BLOCK} = ns.block_id)
{summary('SELECT * FROM np')}""",
)
def q_shuffle_blocks(spark, base):
    return block_summary(shuffle_blocks(blocks_of(spark, base), BLOCK, 7), PART)


@register(
    "noise_tokens",
    f"""WITH {POS}, {BUDGET},
b AS (SELECT split, domain, coalesce(sum(T) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lens),
ap AS (SELECT p.split, p.id, p.pos + b.base AS pos FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain),
tot AS (SELECT split, sum(T) AS T FROM lens GROUP BY split),
dr AS (SELECT split, T, unnest(range(n)) AS j FROM budget JOIN tot USING (split)),
src AS (SELECT split, j, CAST(floor({sql.hash_uniform(11, 'split', "'all'", 'j')} * T) AS BIGINT) AS sp FROM dr),
np AS (SELECT s.split, 'noise' AS domain, a.id, s.j AS pos FROM src s JOIN ap a ON a.split = s.split AND a.pos = s.sp)
{summary('SELECT * FROM np')}""",
)
def q_noise_tokens(spark, base):
    tok = tokens_of(spark, base)
    all_blocks = session_cached(spark, f"all-blocks:{documents_version(spark, base)}:{BLOCK}", lambda: concat_domains(tok, BLOCK))
    sizes = common_length_budget(tok).select(
        "split", F.lit("all").alias("domain"), F.col("budget").alias("n")
    )
    return block_summary(noise_tokens(all_blocks, BLOCK, sizes, 11), PART)


@register(
    "resample_spans",
    f"""WITH {POS},
sp AS (SELECT split, domain, T, unnest(range(T // {CTX_RESAMPLE})) AS i FROM lens WHERE T >= {CTX_RESAMPLE}),
st AS (SELECT *, CAST(floor({sql.hash_uniform(13, 'split', 'domain', 'i')} * (T - {CTX_RESAMPLE} + 1)) AS BIGINT) AS start FROM sp),
np AS (SELECT st.split, st.domain, p.id, st.i * {CTX_RESAMPLE} + p.pos - st.start AS pos FROM st JOIN pos p
  ON p.split = st.split AND p.domain = st.domain AND p.pos >= st.start AND p.pos < st.start + {CTX_RESAMPLE})
{summary('SELECT * FROM np')}""",
)
def q_resample_spans(spark, base):
    blocks = blocks_of(spark, base)
    sizes = stream_lengths(store_of(spark, base)).select("split", "domain", F.col("stream_len").alias("n"))
    return block_summary(resample_spans(blocks, BLOCK, sizes, CTX_RESAMPLE, 13), PART)


@register(
    "mix_by_rate",
    f"""WITH {POS}, {BUDGET},
k AS (SELECT split, count(*) AS k FROM lens GROUP BY split),
r AS (SELECT l.split, l.domain, l.T, CAST(floor(b.n * (CAST(1.0 AS DOUBLE) / k.k)) AS BIGINT) AS n FROM lens l JOIN k USING (split) JOIN budget b USING (split)),
u AS (SELECT *, CASE WHEN T >= {CTX_MIX} THEN (n // {CTX_MIX}) * {CTX_MIX} ELSE 0 END AS used FROM r),
bs AS (SELECT *, coalesce(sum(used) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM u),
sp AS (SELECT split, domain, T, base, unnest(range(n // {CTX_MIX})) AS i FROM bs WHERE T >= {CTX_MIX}),
st AS (SELECT *, CAST(floor({sql.hash_uniform(17, 'split', 'domain', 'i')} * (T - {CTX_MIX} + 1)) AS BIGINT) AS start FROM sp),
np AS (SELECT st.split, 'mix' AS domain, p.id, st.base + st.i * {CTX_MIX} + p.pos - st.start AS pos FROM st JOIN pos p
  ON p.split = st.split AND p.domain = st.domain AND p.pos >= st.start AND p.pos < st.start + {CTX_MIX})
{summary('SELECT * FROM np')}""",
)
def q_mix_by_rate(spark, base):
    tok = tokens_of(spark, base)
    blocks = blocks_of(spark, base)
    budgets = common_length_budget(tok).select("split", F.col("budget").alias("n"))
    return block_summary(mix_by_rate(blocks, BLOCK, budgets, None, CTX_MIX, 17), PART)


RATES = {"src3": 0.5, "src0": 0.2, "src11": 0.3}


def _named(values: dict[str, float]) -> str:
    rows = ", ".join(f"('{d}', CAST({v!r} AS DOUBLE), {i})" for i, (d, v) in enumerate(values.items()))
    return f"named AS (SELECT * FROM (VALUES {rows}) AS v(domain, weight, nth))"


@register(
    "mix_by_rate_explicit",
    f"""WITH {POS}, {BUDGET}, {_named(RATES)},
r AS (SELECT l.split, l.domain, v.nth, l.T, CAST(floor(b.n * v.weight) AS BIGINT) AS n FROM lens l JOIN named v USING (domain) JOIN budget b USING (split)),
u AS (SELECT *, CASE WHEN T >= {CTX_RESAMPLE} THEN (n // {CTX_RESAMPLE}) * {CTX_RESAMPLE} ELSE 0 END AS used FROM r),
bs AS (SELECT *, coalesce(sum(used) OVER (PARTITION BY split ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM u),
sp AS (SELECT split, domain, T, base, unnest(range(n // {CTX_RESAMPLE})) AS i FROM bs WHERE T >= {CTX_RESAMPLE}),
st AS (SELECT *, CAST(floor({sql.hash_uniform(37, 'split', 'domain', 'i')} * (T - {CTX_RESAMPLE} + 1)) AS BIGINT) AS start FROM sp),
np AS (SELECT st.split, 'mix' AS domain, p.id, st.base + st.i * {CTX_RESAMPLE} + p.pos - st.start AS pos FROM st JOIN pos p
  ON p.split = st.split AND p.domain = st.domain AND p.pos >= st.start AND p.pos < st.start + {CTX_RESAMPLE})
{summary('SELECT * FROM np')}""",
)
def q_mix_by_rate_explicit(spark, base):
    budgets = common_length_budget(tokens_of(spark, base)).select("split", F.col("budget").alias("n"))
    return block_summary(mix_by_rate(blocks_of(spark, base), BLOCK, budgets, RATES, CTX_RESAMPLE, 37), PART)


@register(
    "window_starts",
    f"""WITH {POS}
SELECT split, domain, unnest(range(0, T - {SEQ}, {SEQ})) AS start FROM lens WHERE T > {SEQ}""",
)
def q_window_starts(spark, base):
    return window_starts(stream_lengths(store_of(spark, base)), SEQ).select("split", "domain", "start")


def _window_sums(draws: str) -> str:
    """x / y checksums of windows ``draws(..., split, domain, start)`` against ``pos``."""
    return f"""SELECT d.*, 
  CAST(sum(CASE WHEN p.pos < d.start + {SEQ} THEN (p.pos - d.start + 1) * (p.id + 1) ELSE 0 END) AS BIGINT) AS x_checksum,
  CAST(sum(CASE WHEN p.pos > d.start THEN (p.pos - d.start) * (p.id + 1) ELSE 0 END) AS BIGINT) AS y_checksum
FROM ({draws}) d JOIN pos p ON p.split = d.split AND p.domain = d.domain AND p.pos >= d.start AND p.pos <= d.start + {SEQ}
GROUP BY ALL"""


def _nw(T="T"):
    return f"CAST(ceil(({T} - {SEQ}) / {SEQ}) AS BIGINT)"


@register(
    "sample_windows",
    f"""WITH {POS},
dr AS (SELECT split, domain, {_nw()} AS nw, unnest(range(8)) AS sample_id FROM lens WHERE T > {SEQ}),
st AS (SELECT split, domain, sample_id, CAST(floor({sql.hash_uniform(19, 'split', 'domain', 'sample_id')} * nw) AS BIGINT) * {SEQ} AS start FROM dr)
{_window_sums('SELECT * FROM st')}""",
)
def q_sample_windows(spark, base):
    s = sample_windows(store_of(spark, base), BLOCK, SEQ, 8, 19)
    return s.select(
        "split", "domain", "sample_id", "start",
        ids_checksum("x").alias("x_checksum"), ids_checksum("y").alias("y_checksum"),
    )


WEIGHTED = f"""tbl AS (SELECT domain, {_nw()} AS nw, row_number() OVER (ORDER BY domain) - 1 AS domain_id,
    CAST(row_number() OVER (ORDER BY domain) - 1 AS DOUBLE) / count(*) OVER () AS lo,
    CAST(row_number() OVER (ORDER BY domain) AS DOUBLE) / count(*) OVER () AS hi
  FROM lens WHERE split = 'train' AND T > {SEQ}),
dr AS (SELECT range AS sample_id, {sql.hash_uniform(23, "'domain'", 'range')} AS u FROM range({{b}})),
st AS (SELECT 'train' AS split, t.domain, dr.sample_id, t.domain_id,
    CAST(floor({sql.hash_uniform(23, "'window'", 'dr.sample_id')} * t.nw) AS BIGINT) * {SEQ} AS start
  FROM dr JOIN tbl t ON dr.u >= t.lo AND dr.u < t.hi)"""


@register(
    "sample_domains_weighted",
    f"""WITH {POS}, {WEIGHTED.format(b=64)}
SELECT sample_id, domain, domain_id, start, x_checksum, y_checksum FROM ({_window_sums('SELECT * FROM st')})""",
)
def q_sample_domains_weighted(spark, base):
    s = sample_domains_weighted(store_of(spark, base), BLOCK, SEQ, 64, 23)
    return s.select(
        "sample_id", "domain", "domain_id", "start",
        ids_checksum("x").alias("x_checksum"), ids_checksum("y").alias("y_checksum"),
    )


@register(
    "sample_with_domain_ids",
    f"""WITH {POS}, {WEIGHTED.format(b=64)}
SELECT sample_id, domain_id, CAST({SEQ} AS BIGINT) AS n_token_ids, CAST({SEQ} * domain_id AS BIGINT) AS token_ids_sum,
  x_checksum FROM ({_window_sums('SELECT * FROM st')})""",
)
def q_sample_with_domain_ids(spark, base):
    s = sample_with_domain_ids(store_of(spark, base), BLOCK, SEQ, 64, 23)
    return s.select(
        "sample_id", "domain_id",
        F.size("token_domain_ids").cast("long").alias("n_token_ids"),
        F.aggregate("token_domain_ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("token_ids_sum"),
        ids_checksum("x").alias("x_checksum"),
    )


WEIGHTS = {"src3": 0.5, "src0": 2.0, "src11": 1.0}
EXPLICIT = f"""{_named(WEIGHTS)},
tbl AS (SELECT domain, {_nw()} AS nw, row_number() OVER (ORDER BY nth) - 1 AS domain_id,
    (sum(weight) OVER (ORDER BY nth) - weight) / sum(weight) OVER () AS lo, sum(weight) OVER (ORDER BY nth) / sum(weight) OVER () AS hi
  FROM lens JOIN named USING (domain) WHERE split = 'train' AND T > {SEQ}),
dr AS (SELECT range AS sample_id, {sql.hash_uniform(53, "'domain'", 'range')} AS u FROM range(64)),
st AS (SELECT 'train' AS split, t.domain, dr.sample_id, t.domain_id,
    CAST(floor({sql.hash_uniform(53, "'window'", 'dr.sample_id')} * t.nw) AS BIGINT) * {SEQ} AS start
  FROM dr JOIN tbl t ON dr.u >= t.lo AND dr.u < t.hi)"""


@register(
    "sample_domains_explicit",
    f"""WITH {POS}, {EXPLICIT}
SELECT sample_id, domain, domain_id, start, x_checksum, y_checksum FROM ({_window_sums('SELECT * FROM st')})""",
)
def q_sample_domains_explicit(spark, base):
    s = sample_domains_weighted(store_of(spark, base), BLOCK, SEQ, 64, 53, WEIGHTS)
    return s.select(
        "sample_id", "domain", "domain_id", "start",
        ids_checksum("x").alias("x_checksum"), ids_checksum("y").alias("y_checksum"),
    )


@register(
    "sample_grouped_by_domain",
    f"""WITH {POS}, {EXPLICIT}
SELECT domain_id, sample_id, row_number() OVER (PARTITION BY domain_id ORDER BY sample_id) - 1 AS nth, x_checksum
FROM ({_window_sums('SELECT * FROM st')})""",
)
def q_sample_grouped_by_domain(spark, base):
    s = sample_with_domain_ids(store_of(spark, base), BLOCK, SEQ, 64, 53, WEIGHTS, grouped=True)
    nth = F.row_number().over(Window.partitionBy("domain_id").orderBy("sample_id")) - 1  # of one batch
    return s.select("domain_id", "sample_id", nth.cast("long").alias("nth"), ids_checksum("x").alias("x_checksum"))


@register(
    "sample_counts",
    f"""WITH {POS}, {WEIGHTED.format(b=256)}
SELECT domain, count(*) AS n_samples FROM st GROUP BY domain""",
)
def q_sample_counts(spark, base):
    return sample_counts(draw_domains(store_of(spark, base), SEQ, 256, 23))


def _train_docs(spark, base):
    docs = table(spark, base, "documents").select("doc_id")
    return split_fraction(docs, "doc_id", 0.5, 2357).where(F.col("split") == "train").drop("split")


TRAIN = f"""train AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql.md5_key(2357, 'doc_id')}, doc_id) - 1 AS r,
  count(*) OVER () AS n FROM documents) WHERE r < floor(CAST(0.5 AS DOUBLE) * n)),
bs AS (SELECT least(64, CAST(ceil(count(*) / 2) AS BIGINT)) AS bs FROM documents)"""


def _epoch_sql(epochs: str) -> str:
    return f"""ex AS (SELECT doc_id, unnest(range({epochs})) AS epoch FROM train),
rk AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY {sql.md5_key(29, 'epoch', 'doc_id')}, doc_id) - 1 AS r FROM ex),
eb AS (SELECT epoch, doc_id, CAST(r // bs AS BIGINT) AS batch, CAST(r % bs AS BIGINT) AS pos FROM rk, bs)"""


@register(
    "epoch_batches",
    f"""WITH {TRAIN}, {_epoch_sql('3')}
SELECT epoch, doc_id, batch, pos FROM eb""",
)
def q_epoch_batches(spark, base):
    n_total = table(spark, base, "documents").count()
    return epoch_batches(_train_docs(spark, base), "doc_id", 64, 3, 29, n_total).select(
        "epoch", "doc_id", "batch", "pos"
    )


@register(
    "batch_schedule",
    f"""WITH {TRAIN}, k AS (SELECT CAST(ceil((SELECT count(*) FROM train) / bs) AS BIGINT) AS k FROM bs),
{_epoch_sql('(SELECT CAST(ceil(100 / k) AS BIGINT) FROM k)')}
SELECT epoch * k + batch AS step, epoch, batch, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS doc_id_sum
FROM eb, k WHERE epoch * k + batch < 100 GROUP BY ALL""",
)
def q_batch_schedule(spark, base):
    n_total = table(spark, base, "documents").count()
    train = _train_docs(spark, base)
    k, epochs = epochs_needed(train.count(), 64, n_total, 100)
    sched = batch_schedule(epoch_batches(train, "doc_id", 64, epochs, 29, n_total, 100), 100, k)
    return sched.groupBy("step", "epoch", "batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").cast("long").alias("doc_id_sum")
    )
