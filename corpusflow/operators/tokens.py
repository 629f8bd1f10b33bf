"""Tokenisation: character ids and byte-pair encoding over Arrow batches.

Tokenised tables carry ``ids ARRAY<INT>`` and ``n_tokens BIGINT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusflow.functions.arrow import lists_from_numpy, row_steps
from corpusflow.functions.text import char_count, char_decode, char_ids

# The GPT-2 pre-tokenisation pattern and its end-of-text token.
GPT2_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
EOT_TEXT = "<|endoftext|>"


@dataclass(frozen=True)
class Vocab:
    """A byte-pair vocabulary: merge ranks, split pattern, special tokens.

    There is no network access for downloading published vocabularies, so the
    default is the byte-level vocabulary (256 byte ranks plus the end-of-text
    token as id 256): its output is the UTF-8 bytes, which makes it exactly
    checkable in SQL. A real rank file is loaded with
    :meth:`from_tiktoken_file`.
    """

    name: str
    ranks: dict = field(hash=False, compare=False)
    pat_str: str = GPT2_PATTERN
    special: tuple = ((EOT_TEXT, 256),)

    @property
    def eot_id(self) -> int:
        return dict(self.special)[EOT_TEXT]

    @property
    def max_id(self) -> int:
        return max([*self.ranks.values(), *dict(self.special).values()])

    @classmethod
    def byte_level(cls) -> "Vocab":
        return cls("bytes", {bytes([i]): i for i in range(256)})

    @classmethod
    def from_tiktoken_file(cls, path: str, name: str, pat_str: str = GPT2_PATTERN, eot_id=None):
        import base64

        ranks = {}
        with open(path, "rb") as fh:
            for line in fh:
                if line.strip():
                    tok, rank = line.split()
                    ranks[base64.b64decode(tok)] = int(rank)
        eot = eot_id if eot_id is not None else len(ranks)
        return cls(name, ranks, pat_str, ((EOT_TEXT, eot),))


_ENCODINGS: dict = {}


def _encoding(payload):
    """One tiktoken encoder per Python worker and vocabulary (told apart by content, not by name)."""
    name, ranks, pat_str, special = payload
    key = (pat_str, tuple(special), hash(frozenset(ranks.items())))
    enc = _ENCODINGS.get(key)
    if enc is None:
        import tiktoken

        enc = tiktoken.Encoding(
            name=f"corpusflow-{name}",
            pat_str=pat_str,
            mergeable_ranks=ranks,
            special_tokens=dict(special),
        )
        _ENCODINGS[key] = enc
    return enc


def _payload(df: DataFrame, vocab: Vocab):
    """The vocabulary, shipped once per executor."""
    return df.sparkSession.sparkContext.broadcast((vocab.name, vocab.ranks, vocab.pat_str, vocab.special))


def _encode_column(df: DataFrame, text: Column, vocab: Vocab, append_eot: bool, allow_special: bool):
    payload = _payload(df, vocab)
    eot = vocab.eot_id if append_eot else None

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoding(payload.value)

        def ids(t):
            x = enc.encode(t, allowed_special="all") if allow_special else enc.encode_ordinary(t)
            return np.asarray(x if eot is None else [*x, eot], dtype=np.int32)

        for s in batches:  # answered in parts: a worker holds the ids of STEP characters (or of one text), not of its batch
            sizes = pc.fill_null(pc.utf8_length(s), 0).to_numpy(zero_copy_only=False)
            for a, b in row_steps(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
                yield lists_from_numpy([ids(t) for t in pc.fill_null(s.slice(a, b - a), "").to_pylist()])

    return encode(text)


def tokenize_bpe(
    df: DataFrame, text_col: str = "text", vocab: Vocab | None = None, append_eot: bool = True
) -> DataFrame:
    """BPE-encode, treating special-token text as ordinary text, and append EOT."""
    vocab = vocab or Vocab.byte_level()
    ids = _encode_column(df, F.col(text_col), vocab, append_eot, allow_special=False)
    return df.withColumn("ids", ids).withColumn("n_tokens", F.size("ids").cast("long"))


def tokenize_raw(
    df: DataFrame,
    text_col: str = "text",
    vocab: Vocab | None = None,
    append_eot: bool = False,
    special: str = "ordinary",
) -> DataFrame:
    """Encode without EOT. ``special``: ``ordinary`` | ``reject`` | ``allow``.

    ``reject`` fails the job (natively, before any Python runs) when a text
    contains special-token text; ``allow`` maps it to the special id.
    """
    vocab = vocab or Vocab.byte_level()
    text = F.col(text_col)
    if special == "reject":
        bad = None
        for tok, _ in vocab.special:
            cond = F.coalesce(F.instr(text, tok) > 0, F.lit(False))
            bad = cond if bad is None else (bad | cond)
        text = F.when(bad, F.raise_error(F.lit("text contains special-token text"))).otherwise(text)
    elif special not in ("ordinary", "allow"):
        raise ValueError(f"unknown special-token policy {special!r}")
    ids = _encode_column(df, text, vocab, append_eot, allow_special=(special == "allow"))
    return df.withColumn("ids", ids).withColumn("n_tokens", F.size("ids").cast("long"))


def tokenize_char(df: DataFrame, text_col: str = "text") -> DataFrame:
    """96-symbol character ids; characters outside the alphabet are dropped, a null text has none.

    ``n_tokens`` is computed independently of ``ids`` so that a query which
    only counts tokens never builds the arrays (column pruning removes them).
    """
    return df.withColumn("ids", char_ids(F.col(text_col))).withColumn(
        "n_tokens", F.coalesce(char_count(F.col(text_col)), F.lit(0)).cast("long")
    )


def detokenize(
    df: DataFrame, ids_col: str = "ids", vocab: Vocab | str | None = None, out_col: str = "text"
) -> DataFrame:
    """Ids back to text (``vocab="char"`` for the character vocabulary, else BPE)."""
    if vocab == "char":
        return df.withColumn(out_col, char_decode(F.col(ids_col)))
    vocab = vocab or Vocab.byte_level()
    payload = _payload(df, vocab)

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        enc = _encoding(payload.value)
        return pa.array(
            [None if x is None else enc.decode(x, errors="replace") for x in ids.to_pylist()],
            pa.string(),
        )

    return df.withColumn(out_col, decode(F.col(ids_col)))
