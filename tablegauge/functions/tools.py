"""Tool choice: which tools a request should have used, and whether it did."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv


def tool_array(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def expected_tools(family: Column) -> Column:
    """Tools a family of requests calls for; NULL for an unknown family."""
    table = F.create_map(*[part for name, tools in fv.EXPECTED_TOOLS.items()
                           for part in (F.lit(name), tool_array(tools))])
    return table[family]


def tool_set(tools: Column) -> Column:
    """Canonical form of a set of tools: no schema lookup, no repeats, sorted."""
    present = F.coalesce(tools, tool_array([]))
    return F.sort_array(F.array_distinct(F.array_remove(present, fv.SCHEMA_TOOL)))


def _canonical(tools: Column) -> Column:
    return F.sort_array(F.array_distinct(F.coalesce(tools, tool_array([]))))


def allowed_tool_sets(expected: Column, family: Column, config: Column) -> Column:
    """Accepted tool sets. Filters must also query where the template says to query,
    and may query where the template only asks for figures."""
    base = _canonical(expected)
    extended = _canonical(F.array_union(base, tool_array([fv.QUERY_TOOL])))
    is_filter = F.coalesce(family == "filter", F.lit(False))
    return (F.when(is_filter & (config == "format_query"), F.array(extended))
            .when(is_filter & (config == "format"), F.array(base, extended))
            .otherwise(F.array(base)))


def tool_choice_ok(seen: Column, expected: Column, family: Column, config: Column) -> Column:
    """Is the set of used tools an accepted one? Compares sets directly, one row at a time."""
    used, base = tool_set(seen), _canonical(expected)
    extended = _canonical(F.array_union(expected, tool_array([fv.QUERY_TOOL])))
    is_filter = family == "filter"
    return (F.when(is_filter & (config == "format_query"), used == extended)
            .when(is_filter & (config == "format"), (used == base) | (used == extended))
            .otherwise(used == base))


def called(tools: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(tools, name), F.lit(False))


def api_calls(tools: Column) -> Column:
    """Calls of one request: the final answer plus one per tool request."""
    return F.lit(1) + F.coalesce(F.size(tools), F.lit(0))
