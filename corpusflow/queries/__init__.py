"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB oracle per key."""

from corpusflow.queries.registry import ORACLES, QUERIES  # noqa: F401
from corpusflow.queries import composites, corpus, io, live, mixes, scores, streams  # noqa: F401  (registers)
