"""Columns that an operator does not use pass it under names that it does not use either."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def passing(docs: DataFrame, used: Collection[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``docs``, whose columns outside ``used`` bear other names meanwhile, so that none can clash.

    ``run`` returns columns of its argument, in any order, and new ones whose names are not in ``docs``.
    """
    aside = {c: f"passed_{i}" for i, c in enumerate(docs.columns) if c not in used}
    out = run(docs.select(*[_named(c).alias(aside.get(c, c)) for c in docs.columns]))
    back = {v: k for k, v in aside.items()}
    return out.select(*[_named(c).alias(back.get(c, c)) for c in out.columns])
