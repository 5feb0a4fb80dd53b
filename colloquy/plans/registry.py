"""All registered queries."""

from colloquy.plans import queries_evaluation, queries_items, queries_runs, queries_segments, queries_sources, queries_vectors  # noqa: F401
from colloquy.plans.catalog import ORACLES, QUERIES, oracle_sql  # noqa: F401
