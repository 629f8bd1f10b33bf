"""Queries over corpora composed of the domain streams, each by its key in the catalog."""

from __future__ import annotations

from corpusflow.operators.packing import block_summary
from corpusflow.plans.catalog import TAILS, VAL_HEAD, corpus_catalog
from corpusflow.queries import sql
from corpusflow.queries.mixes import BUDGET, CTX_MIX, POS, summary
from corpusflow.queries.registry import register
from corpusflow.queries.streams import BLOCK, PART


@register(
    "corpus_with_all",
    f"""WITH {POS},
c AS (SELECT split, domain, CASE WHEN split = 'val' THEN least(T, {VAL_HEAD * BLOCK}) ELSE T END AS n FROM lens),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c),
k AS (SELECT p.split, p.domain, p.id, p.pos, b.base FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain WHERE p.pos < b.n),
np AS (SELECT split, domain, id, pos FROM k UNION ALL SELECT split, 'all' AS domain, id, pos + base AS pos FROM k)
{summary('SELECT * FROM np')}""",
)
def q_corpus_with_all(spark, base):
    return block_summary(corpus_catalog(spark, "documents+all", base), PART)


@register(
    "corpus_with_noise",
    f"""WITH {POS}, {BUDGET},
b AS (SELECT domain, T, coalesce(sum(T) OVER (ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lens WHERE split = 'train'),
ap AS (SELECT p.id, p.pos + b.base AS pos FROM pos p JOIN b ON p.domain = b.domain WHERE p.split = 'train'),
dr AS (SELECT split, unnest(range(n)) AS j FROM budget),
src AS (SELECT split, j, CAST(floor({sql.hash_uniform(41, 'split', "'all'", 'j')} * (SELECT sum(T) FROM b)) AS BIGINT) AS sp FROM dr),
np AS (SELECT split, domain, id, pos FROM pos
  UNION ALL SELECT s.split, 'noise' AS domain, a.id, s.j AS pos FROM src s JOIN ap a ON a.pos = s.sp)
{summary('SELECT * FROM np')}""",
)
def q_corpus_with_noise(spark, base):
    return block_summary(corpus_catalog(spark, "documents+noise", base), PART)


@register(
    "corpus_with_mixture",
    f"""WITH {POS}, {BUDGET},
r AS (SELECT b.split, l.domain, l.T, CAST(floor(b.n * (CAST(1.0 AS DOUBLE) / count(*) OVER (PARTITION BY b.split))) AS BIGINT) AS n
  FROM lens l, budget b WHERE l.split = 'train'),
u AS (SELECT *, CASE WHEN T >= {CTX_MIX} THEN (n // {CTX_MIX}) * {CTX_MIX} ELSE 0 END AS used FROM r),
bs AS (SELECT *, coalesce(sum(used) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM u),
sp AS (SELECT split, domain, T, base, unnest(range(n // {CTX_MIX})) AS i FROM bs WHERE T >= {CTX_MIX}),
st AS (SELECT *, CAST(floor({sql.hash_uniform(43, 'split', 'domain', 'i')} * (T - {CTX_MIX} + 1)) AS BIGINT) AS start FROM sp),
np AS (SELECT split, domain, id, pos FROM pos
  UNION ALL SELECT st.split, 'mix' AS domain, p.id, st.base + st.i * {CTX_MIX} + p.pos - st.start AS pos FROM st JOIN pos p
    ON p.split = 'train' AND p.domain = st.domain AND p.pos >= st.start AND p.pos < st.start + {CTX_MIX})
{summary('SELECT * FROM np')}""",
)
def q_corpus_with_mixture(spark, base):
    return block_summary(corpus_catalog(spark, "documents+mix", base), PART)


@register(
    "corpus_with_shuffled_tails",
    f"""WITH {POS},
c AS (SELECT split, domain, T, greatest(T - CASE split WHEN 'train' THEN {TAILS['train'] * BLOCK} ELSE {TAILS['val'] * BLOCK} END, 0) AS cut FROM lens),
b AS (SELECT split, domain, cut, CASE WHEN split = 'val' THEN least(T, {TAILS['val'] * BLOCK}) ELSE cut END AS keep,
  coalesce(sum(T - cut) OVER (PARTITION BY split ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c),
mx AS (SELECT p.split, 'mix' AS domain, p.id, b.base + p.pos - b.cut AS pos FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain WHERE p.pos >= b.cut),
bk AS (SELECT split, domain, pos // {BLOCK} AS block_id, count(*) AS sz FROM mx GROUP BY ALL),
ns AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY split ORDER BY {sql.md5_key(47, 'split', 'domain', 'block_id')}, block_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS noff FROM bk),
np AS (SELECT p.split, p.domain, p.id, p.pos FROM pos p JOIN b ON p.split = b.split AND p.domain = b.domain WHERE p.pos < b.keep
  UNION ALL SELECT m.split, m.domain, m.id, ns.noff + m.pos - ns.block_id * {BLOCK} AS pos
    FROM mx m JOIN ns ON m.split = ns.split AND m.pos // {BLOCK} = ns.block_id)
{summary('SELECT * FROM np')}""",
)
def q_corpus_with_shuffled_tails(spark, base):
    return block_summary(corpus_catalog(spark, "documents+tails", base), PART)
