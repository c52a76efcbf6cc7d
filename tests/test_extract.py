"""Extraction from nested turns, turn tables and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.operators import extract
from tablegauge.sources.schemas import TURNS

U, Q, G, R = fv.UPDATE_TOOL, fv.QUERY_TOOL, fv.SCHEMA_TOOL, fv.RESET_TOOL


def c(kind, text=None, name=None, query=None):
    return (kind, text, name, query)


CONVERSATIONS = [
    (1, [("user", None, [c("text", "hi")]),
         ("assistant", [10, 5, 2], [c("reasoning", "hm"), c("tool", name=G), c("tool", name=Q, query="SELECT 1")]),
         ("user", [99, 99, 99], []),
         ("assistant", [7, 3], [c("tool", name=Q), c("tool", name=U, query="x")]),
         ("assistant", [1, None, 4], [c("text", " \n first "), c("reasoning", "zz"), c("text", "second\x1c\n")])],
     ["a", "b"], [True], None, None),
    (2, [("user", None, [c("text", "hi")])], [], [], "APIError", "m" * 400),
    (3, [], None, None, "E", None),
    (4, [("assistant", None, [c("reasoning", "only")])], ["a"], None, None, None),
]


def results(spark):
    frame = spark.createDataFrame(
        CONVERSATIONS, f"id int, turns {TURNS.replace(': ', ':')}, updates array<string>, resets array<boolean>, "
        "error_type string, error_message string")
    return {r.id: r for r in extract.run_results(frame).collect()}


def test_nested_conversations(spark):
    r = results(spark)
    assert (r[1].tokens_in, r[1].tokens_out, r[1].tokens_cached) == (18, 8, 6)
    assert r[1].tools == [G, Q, Q, U] and r[1].query_sql == ["SELECT 1", ""]
    assert r[1].text == "first \nsecond" and r[1].update_sql == "b" and r[1].reset is True and r[1].error is None
    assert (r[2].text, r[2].update_sql, r[2].reset, r[2].tools) == ("", None, False, [])
    assert r[2].error == "APIError: " + "m" * 300
    assert (r[3].tokens_in, r[3].tools, r[3].text, r[3].error) == (0, [], "", "E: ")
    assert r[4].text == "" and r[4].update_sql == "a" and r[4].reset is False


def test_turn_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q", None), (1, 1, "assistant", " a\n", [3, 2]), (2, 0, "assistant", "x", [1, 1, 1]),
                                  (2, 1, "user", "y", [9, 9, 9])],
                                 "conv_id int, turn int, role string, text string, tokens array<bigint>")
    assert {r.conv_id: (r.last_role, r.text) for r in extract.last_answers(rows).collect()} == {
        1: ("assistant", "a"), 2: ("user", "")}
    sums = {r.conv_id: (r.tokens_in, r.tokens_out, r.tokens_cached)
            for r in extract.summed_turn_tokens(rows, "conv_id").collect()}
    assert sums == {1: (3, 2, 0), 2: (1, 1, 1)}


def test_call_table(spark):
    calls = spark.createDataFrame([(1, 0, G, None), (1, 1, U, "first"), (1, 2, Q, "q"), (1, 3, U, "last"), (1, 4, U, None),
                                   (2, 0, R, None)], "run int, position int, name string, statement string")
    got = {r.run: (r.tools, r.n_tools, r.update_sql, r.reset) for r in extract.tool_call_results(calls, "run").collect()}
    assert got == {1: (sorted([G, Q, U]), 5, "last", False), 2: ([R], 1, None, True)}


def test_kept_attempts(spark):
    limit = "RateLimitError: try again in 2s"
    attempts = spark.createDataFrame(
        [("a", i, e) for i, e in enumerate([limit, limit, None, "APIError: x"])]
        + [("b", i, limit) for i in range(9)] + [("c", 0, "APIError: x"), ("c", 1, None)], "request string, attempt int, error string")
    kept = {r.request: (r.attempt, r.retries, r.error) for r in extract.kept_attempts(attempts, ["request"]).collect()}
    assert kept == {"a": (2, 2, None), "b": (8, 8, limit), "c": (0, 0, "APIError: x")}
    cut = {r.request: r.attempt for r in extract.kept_attempts(attempts, ["request"], max_retries=6).collect()}
    assert cut == {"a": 2, "b": 6, "c": 0}


def test_last_update_ignores_missing_statements(spark):
    from tablegauge.operators.dashboard import last_updates, title_or_default

    rows = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("x", 3, None), ("y", 9, None), (None, 1, "c")], "who string, at int, sql string")
    assert {tuple(r) for r in last_updates(rows, ["who"], "sql", "at").collect()} == {("x", "b"), ("y", None), (None, "c")}
    titles = spark.createDataFrame([(None,), ("",), ("x",)], "t string").select(title_or_default(F.col("t"), "d"))
    assert [r[0] for r in titles.collect()] == ["d", "d", "x"]


def test_one_row_a_group_without_sorting_aggregates(spark):
    """The first row of each group is kept in every task before the shuffle, hot groups and NULLs included."""
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"),
                                      (F.col("id") * 7919 % 10_007).alias("o"), F.col("id").cast("string").alias("payload"))
    first = extract.first_of_each(rows, ["g"], F.asc("o"))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2
    wanted = {}
    for r in rows.collect():
        if r.g not in wanted or r.o < wanted[r.g].o:
            wanted[r.g] = r
    assert {r.g: r for r in first.collect()} == wanted
