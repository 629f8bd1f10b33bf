"""Seeded, partition-independent pseudo randomness.

Every draw is a function of (seed, key) through md5, so a retried task or a
different partitioning gives the same answer -- ``rand()`` would not.
The same expressions are written in DuckDB SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits: exactly representable in a double.
_DIGITS = 13
_SCALE = float(2**52)


def seeded_key(seed, *cols) -> Column:
    """md5 hex of ``'<seed>:<c1>:<c2>...'``; a null part counts as empty."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts.append(F.lit(":"))
        parts.append(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    return F.md5(F.concat(*parts))


def hex_prefix_int(hexcol: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex digits."""
    return F.conv(F.substring(hexcol, 1, digits), 16, 10).cast("long")


def hash_uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1) from (seed, key)."""
    return hex_prefix_int(seeded_key(seed, *cols), _DIGITS).cast("double") / F.lit(_SCALE)


def hash_index(seed, n: Column, *cols) -> Column:
    """Uniform integer in [0, n) from (seed, key)."""
    return F.floor(hash_uniform(seed, *cols) * n.cast("double")).cast("long")
