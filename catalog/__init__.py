"""Registered queries over the given tables, each with the SQL that must agree."""

from catalog import (  # noqa: F401  (registers the queries)
    chain_queries,
    cost_queries,
    dashboard_queries,
    extract_queries,
    ingest_queries,
    report_queries,
    score_queries,
    truth_queries,
)
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
