"""Native text expressions: the character tokeniser and markup stripping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character vocabulary is the sorted set of ASCII letters,
# digits, punctuation, space and newline -- 96 symbols. Sorted, newline comes
# first (id 0), then the printable range space..tilde (codes 32-126, ids 1-95).
CHAR_VOCAB_SIZE = 96
CHAR_OUTSIDE_ALPHABET = "[^\\n -~]"


def char_clean(text: Column) -> Column:
    """Drop every character outside the 96-symbol alphabet."""
    return F.regexp_replace(text, CHAR_OUTSIDE_ALPHABET, "")


def char_ids(text: Column) -> Column:
    """ARRAY<INT> of character ids (other characters are dropped).

    The alphabet filter is a native regex; the byte -> id lookup runs as an
    Arrow batch kernel over the values buffer (see ``functions.arrow``).
    """
    from corpusflow.functions.arrow import char_ids_batch

    return char_ids_batch(char_clean(text))


def char_ids_native(text: Column) -> Column:
    """The same ids with higher-order functions only (no Python; slower per element)."""
    clean = char_clean(text)
    chars = F.split(clean, "")
    ids = F.transform(
        chars, lambda c: F.when(c == F.lit("\n"), F.lit(0)).otherwise(F.ascii(c) - F.lit(31))
    )
    return F.when(F.length(clean) == 0, F.array().cast("array<int>")).otherwise(ids.cast("array<int>"))


def char_count(text: Column) -> Column:
    """Number of character tokens, without building the id array."""
    return F.length(char_clean(text)).cast("long")


def char_decode(ids: Column) -> Column:
    """Inverse of :func:`char_ids` (Arrow batch kernel)."""
    from corpusflow.functions.arrow import char_decode_batch

    return char_decode_batch(ids)


def char_decode_native(ids: Column) -> Column:
    """Inverse of :func:`char_ids` with higher-order functions only."""
    return F.array_join(
        F.transform(ids, lambda i: F.when(i == 0, F.lit("\n")).otherwise(F.char(i + F.lit(31)))), ""
    )


# Markup removal rules, applied in order. Patterns stay inside
# the regex subset shared by Java and RE2 (no back-references, no look-around)
# so the same rules run in the DuckDB oracle; ``$n`` names a captured group.
HTML_RULES = [
    ("(?is)<script[^>]*>.*?</script[^>]*>", " "),
    ("(?is)<style[^>]*>.*?</style[^>]*>", " "),
    ("(?s)<!--.*?-->", " "),
    ("<[^>]*>", " "),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", "\""),
    ("&#39;", "'"),
    ("&amp;", "&"),
    ("[ \t\r\f]+", " "),
]

LATEX_RULES = [
    ("(?m)(^|[^\\\\])%[^\n]*", "$1"),
    ("(?s)\\\\begin\\{(figure|table)\\*?\\}.*?\\\\end\\{(figure|table)\\*?\\}", " "),
    ("[ ~]?\\\\(cite[a-z]*|label|[a-z]*ref|bibliography|bibliographystyle)\\*?(\\[[^\\]]*\\])*\\{[^{}]*\\}", ""),
    ("\\\\(begin|end)\\{[^}]*\\}", " "),
    ("\\$\\$[^$]*\\$\\$", " "),
    ("\\\\[a-zA-Z]+\\*?(\\[[^\\]]*\\])?\\{([^{}]*)\\}", "$2"),
    ("\\\\[a-zA-Z]+\\*?", " "),
    ("[{}$]", ""),
    ("[ \t\r\f]+", " "),
]

MARKUP_RULES = {"html": HTML_RULES, "latex": LATEX_RULES}


def strip_markup_expr(col: Column, dialect: str = "html") -> Column:
    """Plain text from an HTML or LaTeX column as one native regex chain."""
    out = col
    for pattern, repl in MARKUP_RULES[dialect]:
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(out)


def strip_markup_sql(column_sql: str, dialect: str = "html") -> str:
    """The same chain as DuckDB SQL (replacement groups written ``\\n``)."""
    out = column_sql
    for pattern, repl in MARKUP_RULES[dialect]:
        pat = pattern.replace("'", "''")
        rep = re.sub(r"\$(\d)", r"\\\1", repl).replace("'", "''")
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    return f"trim({out})"
