"""Profile states: parts against the whole, exact small numbers, errors of large ones, odd columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import dashboard as dash
from tablegauge.operators import profiles


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(20_000).select(
        "id", (F.col("id") % 7).cast("int").alias("few"), F.when(F.col("id") % 4 > 0, (F.col("id") * 7919 % 20_011) / 3).alias("number"),
        F.concat(F.lit("word "), (F.col("id") * 31 % 5000).cast("string")).alias("many"), (F.col("id") % 3 == 0).alias("flag"),
        F.lit(None).cast("string").alias("nothing"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1))).alias("list"),
        F.create_map(F.lit("a"), F.lit(1)).alias("map"))
    return dash.with_meanings(rows, {"few": "weekday"})


def told(states):
    return {r.column_name: r for r in profiles.described(states).collect()}


def test_parts_make_the_whole(spark, table):
    parts = [profiles.profile_state(table.where(F.col("id") % 5 == i)) for i in range(5)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    whole, merged = told(profiles.profile_state(table)), told(profiles.merged(together))
    for name, row in whole.items():
        other = merged[name]
        assert (row.type, row.meaning, row.n_rows, row.filled) == (other.type, other.meaning, other.n_rows, other.filled)
        assert abs(row.distinct_values - other.distinct_values) <= 0.08 * max(1, row.distinct_values)
    assert whole["few"].meaning == "weekday" and whole["number"].filled == 15_000
    assert merged["few"].distinct_values == 7 and merged["flag"].distinct_values == 2 and merged["nothing"].distinct_values == 0
    assert abs(merged["many"].distinct_values - 5000) <= 400 and abs(merged["id"].distinct_values - 20_000) <= 1600
    low, first, middle, third, high = merged["id"].quartiles
    assert (low, high) == (0, 19_999) and all(abs(got - want) <= 700 for got, want in ((first, 5000), (middle, 10_000), (third, 15_000)))
    assert merged["flag"].quartiles is None and merged["nothing"].quartiles is None
    assert {(v["item"], v["count"]) for v in merged["flag"].frequent} == {("true", 6667), ("false", 13_333)}


def test_vocabulary_names_what_it_leaves_out(table):
    rows = profiles.vocabulary(profiles.profile_state(table), limit=7).collect()
    values = {(r.column_name, r.value, r.n) for r in rows if r.value is not None}
    assert values == {("flag", "true", 6667), ("flag", "false", 13_333)} | {("few", str(i), 2858 if i == 0 else 2857) for i in range(7)}
    left_out = {r.column_name: r.distinct_values for r in rows if r.value is None}
    assert set(left_out) >= {"id", "many", "number"} and left_out["many"] > 4500


def test_one_pass(table):
    plan = profiles.profile_state(table)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Range") == 1


def test_empty_table(table):
    assert {r.n_rows for r in profiles.described(profiles.profile_state(table.limit(0))).collect()} == {0}
