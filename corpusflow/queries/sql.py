"""DuckDB building blocks for the oracles (same md5 ranks and hash draws as Spark)."""

from __future__ import annotations


def md5_key(seed, *cols: str) -> str:
    parts = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5('{seed}:' || {parts})"


def hash_uniform(seed, *cols: str) -> str:
    return f"(CAST(('0x' || substr({md5_key(seed, *cols)}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def split_case(seed, share: float, id_col: str, part: str, names=("train", "val")) -> str:
    return (
        f"CASE WHEN row_number() OVER (PARTITION BY {part} ORDER BY {md5_key(seed, id_col)}, {id_col}) - 1 "
        f"< ceil(CAST({share!r} AS DOUBLE) * count(*) OVER (PARTITION BY {part})) "
        f"THEN '{names[1]}' ELSE '{names[0]}' END"
    )


def documents_corpus(domain_col: str = "source", share: float = 0.05, seed=2357) -> str:
    """CTE body: documents with domain and exact shuffled split."""
    return (
        f"SELECT doc_id, text, {domain_col} AS domain, "
        f"{split_case(seed, share, 'doc_id', 'domain')} AS split FROM documents"
    )


CHAR_CLEAN = "regexp_replace({t}, '[^\\n -~]', '', 'g')"


def char_clean(t: str) -> str:
    return CHAR_CLEAN.format(t=t)


def char_tokens(src: str, order: str = "doc_id") -> str:
    """One row per character token: (split, domain, doc_id, i, id), i 0-based in the doc."""
    return (
        f"SELECT split, domain, {order} AS doc_id, generate_subscripts(c, 1) - 1 AS i, "
        f"CASE WHEN unnest(c) = chr(10) THEN 0 ELSE ascii(unnest(c)) - 31 END AS id "
        f"FROM (SELECT split, domain, {order}, string_split({char_clean('text')}, '') AS c FROM {src} "
        f"WHERE length({char_clean('text')}) > 0)"
    )


def stream_positions(tokens: str, docs: str, part: list[str], order: str = "doc_id") -> str:
    """Per-token stream positions: tokens (part.., doc_id, i, id) + docs (part.., doc_id, n)."""
    p = ", ".join(part)
    on = " AND ".join(f"t.{c} = o.{c}" for c in part)
    return (
        f"SELECT {', '.join('t.' + c for c in part)}, t.id, o.off + t.i AS pos FROM ({tokens}) t JOIN "
        f"(SELECT {p}, {order} AS doc_id, coalesce(sum(n) OVER (PARTITION BY {p} ORDER BY {order} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ({docs})) o "
        f"ON {on} AND t.doc_id = o.doc_id"
    )


def block_summary(positions: str, part: list[str], block_len: int) -> str:
    """Scalar block view matching ``packing.block_summary``."""
    p = ", ".join(part)
    return (
        f"SELECT {p}, CAST(pos // {block_len} AS BIGINT) AS block_id, count(*) AS n_tokens, "
        f"CAST(arg_min(id, pos) AS BIGINT) AS first_id, CAST(arg_max(id, pos) AS BIGINT) AS last_id, "
        f"CAST(sum((pos % {block_len} + 1) * (id + 1)) AS BIGINT) AS checksum "
        f"FROM ({positions}) GROUP BY {p}, pos // {block_len}"
    )


def bytes_md5(text: str, eot: bool) -> str:
    tail = " || '0100'" if eot else ""
    return f"md5(regexp_replace(hex(encode({text})), '(..)', '00\\1', 'g'){tail})"
