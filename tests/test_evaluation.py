"""A small evaluation from conversations to report tables, and the lookup joins behind it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablegauge import corpus, fixed_values as fv
from tablegauge.operators import lookup as lk
from tablegauge.operators import scoring
from tablegauge.plans import evaluation, report, truth
from tablegauge.sources.schemas import TURNS

U, Q = fv.UPDATE_TOOL, fv.QUERY_TOOL
SCHEMA = ("model string, provider string, reasoning string, config string, sample_id string, epoch int, attempt int, started string, "
          f"turns {TURNS.replace(': ', ':')}, updates array<string>, resets array<boolean>, error_type string, error_message string")
ZORGON = "SELECT * FROM crashes WHERE planet = 'Zorgon'"
STATED = "🎯 📊 30 rows | survival rate: 60% 💡"


def conversation(sample, config, attempt, tools, text, update=None, error=(None, None)):
    calls = [("tool", None, t, "SELECT 1" if t == Q else update) for t in tools]
    turns = [("user", None, [("text", "ask", None, None)]), ("assistant", [10, 2, 0], calls),
             ("assistant", [5, 1], [("text", text, None, None)])]
    return ("vendor/m", fv.DEFAULT_PROVIDER, "default", config, sample, 1, attempt, "2026-10-08", turns,
            [update] if update else [], None, *error)


def test_evaluation(spark, crash_table):
    limited = ("RateLimitError", "try again in 2s")
    logged = spark.createDataFrame([
        conversation("crashes:zorgon:0", "format_query", 0, [], "", error=limited),
        conversation("crashes:zorgon:0", "format_query", 1, [U, Q], STATED, ZORGON),
        conversation("crashes:zorgon:1", "format", 0, [U], STATED, ZORGON.upper()),
        conversation("crashes:pilots:0", "baseline", 0, [U], "done", "SELECT * FROM crashes WHERE crew_role = 'pilot'"),
        conversation("crashes:pilots:1", "baseline", 0, [U], "done", "DROP TABLE crashes"),
        conversation("crashes:rate_medics:0", "baseline", 0, [Q], "It was 31.6%."),
        conversation("crashes:reset:0", "baseline", 0, [fv.RESET_TOOL], "reset", error=("APIError", "Failed to parse tool call")),
    ], SCHEMA)
    samples = truth.build_samples(crash_table, corpus.INTENTS["crashes"])
    scored = evaluation.score_conversations(logged, samples, {"crashes": crash_table})
    got = {r.sample_id: [r[s] for s in fv.SCORES] + [r.honesty, r.retries] for r in scored.collect()}
    assert got == {
        "crashes:zorgon:0": [1.0, 1.0, None, 1.0, 1.0, "honest", 1],
        "crashes:zorgon:1": [1.0, 0.0, None, 1.0, 0.0, "unverified", 0],
        "crashes:pilots:0": [1.0, 1.0, None, None, None, None, 0],
        "crashes:pilots:1": [1.0, 0.0, None, None, None, None, 0],
        "crashes:rate_medics:0": [1.0, None, 1.0, None, None, None, 0],
        "crashes:reset:0": [0.0, None, None, None, None, None, 0]}
    facts = scoring.facts(scored)
    tables = report.report_tables(report.cells(facts, report.DIMENSIONS), "titanic", "crashes", ["malformed tool call"])
    assert {(r.config, r.filter_rows) for r in tables["control_scores"].collect()} == {
        ("baseline", 50), ("format", 0), ("format_query", 100)}
    assert tables["errors"].first()["malformed tool call"] == 1
    assert report.run_facts(facts).first().requests == 6


@pytest.mark.parametrize("limit", [lk.BROADCAST_BYTES, 0])
def test_lookup_with_a_hot_key(spark, monkeypatch, limit):
    monkeypatch.setattr(lk, "BROADCAST_BYTES", limit)
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2500).alias("k"))
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = lk.lookup(left, right, ["k"], ["id"])
    assert set(joined.columns) >= {"id", "k", "v"} and joined.count() == 6000
    expected = F.when(F.col("k") < 2000, F.col("k") * 10)
    assert joined.where(~F.col("v").eqNullSafe(expected)).count() == 0


def test_lookup_without_hot_keys(spark):
    left = spark.range(5).select("id", F.col("id").alias("k"))
    joined = lk.salted_lookup(left, spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v")), [("k", "k")], [], ["id"])
    assert joined.count() == 5 and joined.where("v = 1").count() == 3


def test_hot_keys_are_spread(spark):
    uses = spark.createDataFrame([("hot", 5000), *[(f"k{i}", 1) for i in range(2000)]], "k string, uses bigint")
    hot = lk.hot_hashes(uses, ["k"])
    assert len(hot) == 1
    left = spark.range(5000).select("id", F.lit("hot").alias("k"))
    joined = lk.salted_lookup(left, uses.limit(1), [("k", "k")], hot, ["id"])
    plan = joined._sc._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert "_salt" in plan and joined.count() == 5000 and joined.where("uses is null").count() == 0
