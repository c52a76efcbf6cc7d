"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablegauge import fixed_values as fv

Query = Callable[[SparkSession, str], DataFrame]

# Names that logs rely on, as the SQL texts write them.
PLACEHOLDERS = {"<schema>": fv.SCHEMA_TOOL, "<update>": fv.UPDATE_TOOL, "<query>": fv.QUERY_TOOL,
                "<reset>": fv.RESET_TOOL, "<home>": fv.DEFAULT_PROVIDER}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` is its equivalent over the same tables."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            text = sql
            for placeholder, value in PLACEHOLDERS.items():
                text = text.replace(placeholder, value)
            ORACLES[name] = text
        return function

    return register
