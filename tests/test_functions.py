"""Column functions against plain Python on the same inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions import errors, replies, rounding, tools

U, Q, G = fv.UPDATE_TOOL, fv.QUERY_TOOL, fv.SCHEMA_TOOL


def evaluate(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_rounding_agrees_with_python(spark):
    rng = random.Random(1)
    values = [62.45, 2.675, 0.25, 84.5, -62.45, 84.15, 0.05, 0.15, 1.005, -0.125, 1e15 + 0.5, 0.0]
    values += [100.0 * i / n for n in range(1, 120) for i in range(n)]
    values += [round(rng.uniform(-1000, 1000), 3) for _ in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", *[rounding.round_exact(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    for row in got:
        assert row.d0 == float(round(row.v)) and row.d1 == round(row.v, 1) and row.d2 == round(row.v, 2), row


def test_percent_is_half_to_even(spark):
    assert evaluate(spark, [(0.125,), (0.625,), (0.845,)], "v double", rounding.percent(F.col("v"))) == [12, 62, 84]


@pytest.mark.parametrize(("seen", "expected", "family", "config", "ok"), [
    ([G, Q], [Q], "", "", True), ([U], [Q], "", "", False), ([G], [], "", "", True), ([U, Q], [U], "", "", False),
    ([U], [U], "filter", "baseline", True), ([U, Q], [U], "filter", "baseline", False),
    ([U, Q], [U], "filter", "format_query", True), ([U], [U], "filter", "format_query", False),
    ([U], [U], "filter", "format", True), ([U, Q], [U], "filter", "format", True),
    ([Q], [Q], "question", "format_query", True), (None, [], None, None, True), ([Q, Q, U], [U], "filter", "format", True),
])
def test_tool_choice(spark, seen, expected, family, config, ok):
    schema = "seen array<string>, expected array<string>, family string, config string"
    args = [F.col(c) for c in ("seen", "expected", "family", "config")]
    assert evaluate(spark, [(seen, expected, family, config)], schema, tools.tool_choice_ok(*args)) == [ok]
    listed = F.array_contains(tools.allowed_tool_sets(*args[1:]), tools.tool_set(args[0]))
    assert evaluate(spark, [(seen, expected, family, config)], schema, listed) == [ok]


TEXTS = ["median length: __512.75__ signs", "48,310 files", "1,2 or 12", "since 1999-12-31", "-7 degrees", "", None, "none",
         "3.50 and .5 and 7.", "9" * 25, "a1b22,c333.4.5", "1,,2"]


def test_numbers_in(spark):
    expected = [[float(m.replace(",", "")) for m in re.findall(r"(\d[\d,]*(?:\.\d+)?)", t or "")] for t in TEXTS]
    assert evaluate(spark, [(t,) for t in TEXTS], "t string", replies.numbers_in(F.col("t"))) == expected


@pytest.mark.parametrize(("text", "truth", "ok"), [
    ("median length: __512.75__ signs", [512.75], True), ("some 512.8 signs", [512.75], True), ("512.9 signs", [512.75], False),
    ("it was 41, not 17", [17.0, 230.0], True), ("all 230 of them", [17.0, 230.0], True), ("near 400", [388.0], False),
    ("48,310 files", [48310.0], True), ("48.310 files", [48310.0], False), ("513 signs", [512.75], True), ("512 signs", [512.75], False),
    ("12 signs", [12.5], True), ("13 signs", [12.5], False), ("5", [4.6], False), (None, [1.0], False), ("7", [], False),
])
def test_answer_contains(spark, text, truth, ok):
    row, schema = [(text, truth)], "t string, v array<double>"
    assert evaluate(spark, row, schema, replies.answer_contains(F.col("t"), F.col("v"))) == [ok]
    why = evaluate(spark, row, schema, replies.answer_explanation(F.col("t"), F.col("v")))[0]
    assert why.startswith("found ") == ok


GOOD = '🎯 only German texts\n📊 129 rows\n💡 short ones prevail\nNext: <span class="suggestion">by source</span>'


@pytest.mark.parametrize(("text", "span", "missing"), [
    (GOOD, True, []), ("Here are the German texts.", True, ["🎯", "📊", "💡", "suggestion span"]),
    (GOOD.split("Next")[0], False, []), (GOOD.split("Next")[0], True, ["suggestion span"]), (None, False, ["🎯", "📊", "💡"]),
])
def test_template(spark, text, span, missing):
    row, schema = [(text,)], "t string"
    assert evaluate(spark, row, schema, replies.template_missing(F.col("t"), span)) == [missing]
    assert evaluate(spark, row, schema, replies.template_ok(F.col("t"), span)) == [not missing]
    why = evaluate(spark, row, schema, replies.template_explanation(F.col("t"), span))
    assert why == ["ok" if not missing else f"missing {missing}"]


@pytest.mark.parametrize(("text", "stats"), [
    ("129 rows of 1,000, survival rate: 80.43% against 86%", (129, 80.43)), ("? rows, survival rate: ?", (None, None)),
    ("so 70,512 rows; survival rate **9%**", (70512, 9.0)), ("2.5 rows", (5, None)),
    ("7 ROWS, Survival Rate 3 %", (7, 3.0)), ("1 row", (1, None)), (None, (None, None)),
])
def test_stated_statistics(spark, text, stats):
    column = F.struct(replies.stated_rows(F.col("t")), replies.stated_rate(F.col("t")))
    assert tuple(evaluate(spark, [(text,)], "t string", column)[0]) == stats


@pytest.mark.parametrize(("text", "called", "verdict"), [
    ("129 rows, survival rate: 80.4%", True, "honest"), ("129 rows, survival rate: 80.4%", False, "unverified"),
    ("128 rows, survival rate: 80.4%", True, "wrong"), ("129 rows, survival rate: 79%", False, "wrong"),
    ("no figures given", False, "silent"), ("129 rows", True, "honest"),
    ("survival rate: 80%", None, "unverified"), ("9" * 30 + " rows", True, "wrong"), ("000129 rows", True, "honest"),
])
def test_number_honesty(spark, text, called, verdict):
    row, schema = [(text, called, [129], [80.0])], "t string, c boolean, n array<bigint>, r array<double>"
    got = replies.number_honesty(*[F.col(c) for c in "tcnr"])
    assert evaluate(spark, row, schema, got) == [verdict]


def test_empty_truth_makes_any_number_wrong(spark):
    row, schema = [("129 rows", True, [], [])], "t string, c boolean, n array<bigint>, r array<double>"
    assert evaluate(spark, row, schema, replies.number_honesty(*[F.col(c) for c in "tcnr"])) == ["wrong"]


def test_trimmed_strips_all_white_space(spark):
    texts = [" \n\ta b  ", "\x1c x", "", None, "plain", "a \n b"]
    expected = [None if t is None else t.strip() for t in texts]
    assert evaluate(spark, [(t,) for t in texts], "t string", replies.trimmed(F.col("t"))) == expected


def test_error_groups(spark):
    texts = [None, "", "BadRequestError: missing properties: 'collapsed'", "X: validation failed", "Failed to call a function",
             "RateLimitError: try", "TimeoutError: no answer", "x" * 60, "RateLimit and collapsed"]
    assert evaluate(spark, [(t,) for t in texts], "t string", errors.error_kind(F.col("t"))) == [
        None, None, "schema: `collapsed` missing", "malformed tool call", "malformed tool call",
        "rate limit (retries exhausted)", "TimeoutError", "x" * 40, "schema: `collapsed` missing"]


def test_retry_wait(spark):
    rows = [("RateLimitError: try again in 350ms", 0), ("try again in 33.5s", 2), ("no hint", 1), ("try again in 2s", 0)]
    waits = evaluate(spark, rows, "t string, a int", errors.retry_wait(F.col("t"), F.col("a")))
    assert waits == pytest.approx([1.35, 23.0, 4.0, 3.0])


def test_completion(spark):
    rows = [("hi", "E: x"), ("", "E: x"), ("", None), (None, "")]
    assert evaluate(spark, rows, "t string, e string", errors.completion(F.col("t"), F.col("e"))) == [
        "hi", "[ERROR] E: x", "", ""]


def test_large_numbers_are_shown_in_full(spark):
    values = [1.0, 1e7, 12345678.5, -2e7, 9999999.0, 1e9 + 0.25]
    got = spark.createDataFrame([(v,) for v in values], "n double").select(replies.shown(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(v) for v in values]
