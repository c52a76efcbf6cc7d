"""Extraction from conversation logs: nested turns, turn tables and attempts.

Nested turns are handled inside their row by array functions. Where turns or calls are
rows of their own, aggregates have a fixed-size state, and where one row of a group is
wanted, tasks keep one each before rows are shuffled. So a conversation of any length is
combined map-side and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions import errors
from tablegauge.functions.replies import trimmed


def first_of_each(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of every group by an order; of equal ones any.

    Spark limits groups to their first row in every task already, so what is shuffled is one row a task and group, however
    many rows a group has.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def summed_tokens(turns: Column, index: int) -> Column:
    """Input (0), output (1) or cached (2) tokens over assistant turns; absent entries are 0."""
    def amount(turn: Column) -> Column:
        counted = (turn["role"] == "assistant") & (F.coalesce(F.size(turn["tokens"]), F.lit(0)) > 0)
        return F.when(counted, F.coalesce(F.get(turn["tokens"], index), F.lit(0))).otherwise(F.lit(0))

    return F.aggregate(F.coalesce(turns, F.array()), F.lit(0).cast("bigint"),
                       lambda total, turn: total + amount(turn))


def tool_requests(turns: Column) -> Column:
    """All requested tools in order, as content parts."""
    contents = F.flatten(F.transform(turns, lambda t: F.coalesce(t["contents"], F.array())))
    return F.filter(contents, lambda c: c["kind"] == "tool")


def tool_names(requests: Column) -> Column:
    """Names of requested tools in order."""
    return F.transform(requests, lambda c: c["name"])


def query_statements(requests: Column) -> Column:
    """SQL sent to the query tool in order; a request without a statement gives the empty text."""
    asked = F.filter(requests, lambda c: c["name"] == fv.QUERY_TOOL)
    return F.transform(asked, lambda c: F.coalesce(c["query"], F.lit("")))


def final_answer(turns: Column) -> Column:
    """Text parts of the last turn, one per line and trimmed, if the assistant spoke last; else empty."""
    last = F.try_element_at(turns, F.lit(-1))
    texts = F.transform(F.filter(last["contents"], lambda c: c["kind"] == "text"), lambda c: c["text"])
    return F.coalesce(F.when(last["role"] == "assistant", trimmed(F.array_join(texts, "\n"))), F.lit(""))


def last_statement(updates: Column) -> Column:
    """The filter that decides the view: the last one sent, NULL without any."""
    return F.try_element_at(updates, F.lit(-1))


def was_reset(resets: Column) -> Column:
    return F.coalesce(F.size(resets), F.lit(0)) > 0


def run_results(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """Flat run results from nested conversations.

    Expects ``turns``, ``updates`` (filter statements in order), ``resets``, ``error_type`` and
    ``error_message`` and keeps all other columns.
    """
    t = F.col(turns)
    error = errors.error_text(F.col("error_type"), F.col("error_message"))
    kept = [c for c in conversations.columns
            if c not in (turns, "updates", "resets", "error_type", "error_message")]
    # The requests are collected once, as a column that both lists are taken from.
    return conversations.withColumn("_requests", tool_requests(t)).select(
        *kept, tool_names(F.col("_requests")).alias("tools"), last_statement(F.col("updates")).alias("update_sql"),
        query_statements(F.col("_requests")).alias("query_sql"), final_answer(t).alias("text"), error.alias("error"),
        was_reset(F.col("resets")).alias("reset"), summed_tokens(t, 0).alias("tokens_in"),
        summed_tokens(t, 1).alias("tokens_out"), summed_tokens(t, 2).alias("tokens_cached"))


def last_answers(turn_rows: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Final answer per conversation from one-row-per-turn tables."""
    last = first_of_each(turn_rows.select(conversation, turn, role, text), [conversation], F.desc_nulls_last(turn))
    spoke = F.when(F.col(turn).isNotNull(), F.col(role))
    return last.select(conversation, spoke.alias("last_role"), F.when(spoke == "assistant", F.coalesce(trimmed(F.col(text)), F.lit("")))
                       .otherwise(F.lit("")).alias("text"))


def summed_turn_tokens(turn_rows: DataFrame, conversation: str, role: str = "role",
                       tokens: str = "tokens") -> DataFrame:
    """Token sums per conversation from one-row-per-turn tables."""
    def total(index: int) -> Column:
        spoke = F.col(role) == "assistant"
        return F.coalesce(F.sum(F.when(spoke, F.get(F.col(tokens), index))), F.lit(0))

    return turn_rows.groupBy(conversation).agg(
        total(0).alias("tokens_in"), total(1).alias("tokens_out"), total(2).alias("tokens_cached"))


def tool_call_results(call_rows: DataFrame, run: str, position: str = "position", name: str = "name",
                      statement: str = "statement") -> DataFrame:
    """Per run, from one-row-per-tool-call tables: distinct tools, number of calls, deciding filter, reset.

    The set of tools is bounded by the tool vocabulary; ordered lists of calls stay rows.
    """
    tool, sql = F.col(name), F.col(statement)
    tools = (fv.SCHEMA_TOOL, fv.UPDATE_TOOL, fv.QUERY_TOOL, fv.RESET_TOOL)
    used = call_rows.groupBy(run).agg(
        F.count(tool).alias("n_tools"), *[F.coalesce(F.max(tool == t), F.lit(False)).alias(f"_{i}") for i, t in enumerate(tools)])
    updates = call_rows.where((tool == fv.UPDATE_TOOL) & sql.isNotNull()).select(
        F.col(run).alias("_run"), F.col(position).alias("_at"), sql.alias("update_sql"))
    deciding = first_of_each(updates, ["_run"], F.desc("_at")).drop("_at")
    names = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(t)) for i, t in enumerate(tools)]))
    return used.join(deciding, F.col(run).eqNullSafe(F.col("_run")), "left").select(
        run, F.sort_array(names).alias("tools"), "n_tools", "update_sql", F.col(f"_{tools.index(fv.RESET_TOOL)}").alias("reset"))


def kept_attempts(attempts: DataFrame, request: list[str], attempt: str = "attempt", error: str = "error",
                  max_retries: int | None = None) -> DataFrame:
    """One attempt per request: the first that is not rate-limited, else the last one.

    All logged attempts count; ``max_retries`` leaves out those beyond a limit that a caller names.
    """
    limited, at = errors.is_rate_limited(F.col(error)), F.col(attempt)
    allowed = attempts if max_retries is None else attempts.where(at <= max_retries)
    return first_of_each(allowed, request, limited, F.when(limited, -at).otherwise(at)).withColumn("retries", at)
