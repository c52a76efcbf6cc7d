"""Scores, logs, report tables, spend and matrix, with published figures as checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.operators import scoring
from tablegauge.plans import cost, matrix, report
from tablegauge.sources import runlogs, tables

U, Q = fv.UPDATE_TOOL, fv.QUERY_TOOL
RUN_SCHEMA = ("id int, model string, dataset string, family string, config string, tools array<string>, expected_tools array<string>, "
              "error string, text string, update_sql string, statement_rows bigint, truth_rows array<bigint>, "
              "truth_rates array<double>, truth_values array<double>, retries int, trap boolean")
GOOD = '🎯 📊 216 rows | survival rate: 62.5% 💡 <span class="suggestion">z</span>'


def run(i, family, config, tools, text="", error=None, sql=None, rows=None, dataset="titanic"):
    return (i, "qwen/qwen3.8-27b", dataset, family, config, tools, fv.EXPECTED_TOOLS[family], error, text, sql, rows,
            [216], [63.0], [84.15], None, None)


RUNS = [
    run(1, "filter", "format_query", [U, Q], GOOD, sql="s", rows=216),
    run(2, "filter", "format_query", [U], GOOD, sql="s", rows=217),
    run(3, "filter", "format", [U], "nothing", error="APIError: x", sql="s", rows=216),
    run(4, "filter", "baseline", [U], "nothing", sql="broken"),
    run(5, "question", "baseline", [Q], "about 84.2"),
    run(6, "out_of_scope", "format", [], "no"),
    run(7, "filter", "format", None, "🎯 📊 💡", dataset="crashes"),
]


def test_scores(spark):
    scored = scoring.score_runs(spark.createDataFrame(RUNS, RUN_SCHEMA), "statement_rows")
    got = {r.id: tuple(r[s] for s in fv.SCORES) + (r.honesty,) for r in scored.collect()}
    assert got == {
        1: (1.0, 1.0, None, 1.0, 1.0, "honest"), 2: (0.0, 0.0, None, 1.0, 0.0, "unverified"),
        3: (0.0, 1.0, None, 0.0, None, "silent"), 4: (1.0, 0.0, None, None, None, None),
        5: (1.0, None, 1.0, None, None, None), 6: (1.0, None, None, None, None, None),
        7: (0.0, 0.0, None, 1.0, None, "silent")}
    facts = {r.error_kind: r for r in scoring.facts(scored.withColumn("provider", F.lit("other"))).collect()}
    assert facts["APIError"].error is True and facts["APIError"].model == "qwen3.8-27b @other"
    assert facts["APIError"].retries == 0 and facts["APIError"].trap is False


def test_explanations(spark):
    why = scoring.explanations()
    rows = {r.id: r for r in spark.createDataFrame(RUNS, RUN_SCHEMA).select(
        "id", *[c.alias(n) for n, c in why.items()]).collect()}
    assert rows[1].tool_choice_why == f"allowed [['{Q}', '{U}']] under format_query"
    assert rows[1].tool_choice_answer == f"['{U}', '{Q}']" and rows[1].number_honesty_why == "216 rows / 62.5% from query"
    assert rows[2].filter_rows_why == "217 rows (want [216]): s" and rows[4].filter_rows_why == "SQL error: broken"
    assert rows[3].tool_choice_why == "API error: APIError: x" and rows[7].filter_rows_why == "no update_dashboard SQL"
    assert rows[5].answer_correct_why == "found 84.2 ~ 84.15" and rows[5].filter_rows_why == "not a filter intent"
    assert rows[3].format_adherence_why == "missing ['🎯', '📊', '💡', 'suggestion span']" and rows[7].format_adherence_why == "ok"
    assert rows[2].number_honesty_why == f"correct 216 rows / 62.5% but no {Q} call"
    assert rows[6].tool_choice_answer == "[]" and rows[6].tool_choice_why == "allowed [[]] under format"


# Published accuracy percents (model: per score, four configs) and composites.
PUBLISHED = {
    "qwen3.8-27b": ([83, 77, 95, 91], [78, 91, 96, 98], [94, 92, 98, 94], 91),
    "qwen3.6-27b": ([74, 79, 89, 91], [85, 98, 93, 99], [90, 81, 92, 96], 89),
    "gpt-oss-20b": ([97, 98, 84, 78], [90, 99, 83, 74], [96, 94, 85, 83], 88),
    "gpt-oss-120b": ([86, 89, 43, 39], [73, 100, 42, 59], [52, 58, 50, 67], 63),
}


def percents(spark):
    rows = [(m, c, s, v) for m, (*tables_, _) in PUBLISHED.items() for s, values in zip(report.COMPOSITE_SCORES, tables_)
            for c, v in zip(fv.CONFIG_ORDER, values)]
    return spark.createDataFrame(rows, "model string, config string, score string, value bigint")


def test_published_ranking(spark):
    ranked = report.ranking(report.composite(percents(spark))).orderBy("rank").collect()
    assert [(r.model, r.composite_pct, r.rank) for r in ranked] == [
        (m, p[-1], i + 1) for i, (m, p) in enumerate(PUBLISHED.items())]
    gap = percents(spark).where("not (model = 'qwen3.6-27b' and score = 'filter_rows' and config = 'format')")
    assert {r.model for r in report.complete_models(gap).collect()} == set(PUBLISHED) - {"qwen3.6-27b"}


def test_published_truncated_mean(spark):
    # Published trap accuracies before and after a column dictionary.
    rows = [("a", 78, 100), ("b", 78, 100), ("c", 96, 100), ("d", 78, 85), ("e", None, 1)]
    table = spark.createDataFrame(rows[:4], "model string, baseline bigint, datadesc bigint")
    assert report.column_summary(table, "baseline").first().mean_value == 82
    assert report.column_summary(table, "datadesc").first() == (96, 85, 100)
    assert report.before_after(spark.createDataFrame(rows, table.schema), "baseline", "datadesc").count() == 4
    assert tuple(report.best(table, "datadesc").first()) == ("a", 100)


FACT_SCHEMA = ("model string, config string, dataset string, family string, trap boolean, intent string, input string, epoch int, "
               "started string, error boolean, error_kind string, api_calls int, retries int, honesty string, "
               + ", ".join(f"{s} double" for s in fv.SCORES))


def fact_rows(spark):
    rows = []
    for i in range(240):
        kind = [None, None, None, "malformed tool call", "TimeoutError"][i % 5]
        verdict = fv.VERDICTS[i % 4] if i % 2 else None
        rows.append((f"m{i % 3}", fv.CONFIG_ORDER[i // 3 % 4], ["main", "control"][i % 7 == 0], fv.FAMILY_ORDER[i % 4], i % 3 == 1,
                     f"i{i % 9}", f"ask {i % 20}", i % 3 + 1, f"2026-10-0{i % 3 + 1}T00:00", kind is not None, kind, 1 + i % 3, i % 2,
                     verdict, float(i % 2), None if i % 3 == 2 else float(i % 4 > 0), None if i % 4 else 1.0, None,
                     {"honest": 1.0, "silent": None, None: None}.get(verdict, 0.0)))
    return rows, spark.createDataFrame(rows, FACT_SCHEMA)


def test_error_kinds_are_bounded(spark):
    """Only the most frequent kinds have columns, the rest is summed, and columns add up to the errors."""
    cells = spark.createDataFrame([("m", f"kind {i:03}", 10, 1 + i % 7) for i in range(100)] + [("m", None, 50, 0)],
                                  "model string, error_kind string, requests bigint, errors bigint")
    row = report.error_table(cells, most=5).first().asDict()
    kinds = [f"kind {i:03}" for i in (6, 13, 20, 27, 34)]
    assert list(row) == ["model", "requests", "errors", "error_rate", *kinds, "other"]
    assert [row[k] for k in kinds] == [7] * 5 and row["other"] + 35 == row["errors"] == sum(1 + i % 7 for i in range(100))
    assert "other" not in report.error_table(cells.where("error_kind < 'kind 005'"), most=5).columns


def test_report_tables_agree_with_pandas(spark):
    import pandas as pd

    rows, facts = fact_rows(spark)
    d = pd.DataFrame(rows, columns=facts.columns)
    kinds = ["malformed tool call", "TimeoutError"]
    built = report.full_report(facts, "main", "control", kinds)
    main = d[d.dataset == "main"]
    expected = (main[main.tool_choice.notna()].groupby(["model", "config"]).tool_choice.mean() * 100).round(0).unstack("config")
    for r in built["tool_choice"].collect():
        assert [r[c] for c in fv.CONFIG_ORDER] == [None if pd.isna(x) else int(x) for x in expected.loc[r.model].reindex(fv.CONFIG_ORDER)]
    counts = d.groupby(["model", "error_kind"]).size().unstack(fill_value=0)
    for r in built["errors"].collect():
        m = d[d.model == r.model]
        rate = str((pd.Series([m.error.sum() / len(m) * 100])).round(1)[0]) + "%"
        assert (r.requests, r.errors, r.error_rate) == (len(m), m.error.sum(), rate)
        assert [r[k] for k in kinds] == [counts.loc[r.model].get(k, 0) for k in kinds]
    for r in built["verdicts"].collect():
        m = main[(main.model == r.model) & (main.config == r.config) & main.honesty.notna()]
        assert [r[v] for v in fv.VERDICTS] == [(m.honesty == v).sum() for v in fv.VERDICTS]
        assert r.honest_share == round((m.honesty == "honest").mean() * 100)
    totals = {r.model: tuple(r)[1:] for r in built["volume"].collect()}
    assert totals[fv.TOTAL_LABEL] == (len(d), d.api_calls.sum(), d.retries.sum())
    shares = {(r.model, r.config): r.value for r in built["untrusted_share"].collect()}
    judged = main[main.honesty.notna()]
    assert shares == pytest.approx(dict(judged.honesty.isin(["wrong", "unverified"]).groupby([judged.model, judged.config]).mean() * 100))
    order = [(r.model, r.config) for r in built["control_scores"].collect()]
    assert order == sorted(order, key=lambda x: (x[0], fv.CONFIG_ORDER.index(x[1])))
    wide = {r.model: r for r in built["filter_rows_traps"].collect()}
    assert {r.model: (r.before, r.after) for r in built["traps_before_after"].collect()} == {
        m: (r.baseline, r.datadesc) for m, r in wide.items() if None not in tuple(r)}
    baseline = [r.baseline for r in built["answer_correct"].collect() if r.baseline is not None]
    assert tuple(built["answers_baseline"].first()) == (
        int(sum(baseline) / len(baseline)), min(baseline), max(baseline))
    for table in built.values():
        table.collect()


def test_coverage_and_run_facts(spark):
    import pandas as pd

    rows, facts = fact_rows(spark)
    d = pd.DataFrame(rows, columns=facts.columns)
    first = d[d.epoch == 1]
    assert [(r.family, r.intents, r.phrasings) for r in report.family_coverage(facts).collect()] == [
        (f, first[first.family == f].intent.nunique(), first[first.family == f].input.nunique()) for f in fv.FAMILY_ORDER]
    assert tuple(report.run_facts(facts).first()) == ("2026-10-01", 3, 4, first.input.nunique(), 240)


def test_facts_from_logs(spark, tmp_path):
    import json

    def log(status, provider, samples):
        return {"status": status, "created": "2026-10-08T10:00", "epochs": 3, "max_samples": 1, "samples": samples,
                "metadata": {fv.MODEL_KEY: "qwen/qwen3.8-27b", "provider": provider, "config": "format", "dataset": "titanic"}}

    store = {"tools": [U, Q], "error": None, "retries": 2, "tokens_in": 5, "tokens_out": 6}
    full = {"id": "a", "input": "x", "epoch": 1, "metadata": {"intent": "i", "family": "filter", "trap": True}, "store": store,
            "scores": {"tool_choice": {"value": "C"}, "filter_rows": {"value": "I"}, "answer_correct": {"value": "N"},
                       "number_honesty": {"value": "N", "metadata": {"verdict": "silent"}}}}
    bare = {"id": "b", "input": "y", "epoch": 2, "metadata": {}, "store": {"error": "RateLimitError: x"}}
    logs = [log("success", None, [full, bare]), log("error", None, [bare]), log("success", "other", []), log("success", "other", [full])]
    (tmp_path / "logs.jsonl").write_text("\n".join(map(json.dumps, logs)))
    samples = runlogs.log_samples(runlogs.read_logs(spark, str(tmp_path / "logs.jsonl")))
    facts = runlogs.facts_from_logs(runlogs.successful(samples)).orderBy("model", "epoch").collect()
    a, b, c = facts
    assert (a.model, a.tool_choice, a.filter_rows, a.answer_correct, a.format_adherence, a.honesty) == (
        "qwen3.8-27b", 1.0, 0.0, None, None, "silent")
    assert (a.trap, a.api_calls, a.retries, a.error) == (True, 3, 2, False)
    assert (b.trap, b.api_calls, b.retries, b.error, b.error_kind) == (False, 1, 0, True, "rate limit (retries exhausted)")
    assert c.model == "qwen3.8-27b @other"
    usage = cost.measured_usage(runlogs.usage_from_logs(samples)).first()
    assert (usage.samples, usage.retries, usage.tokens_in, usage.measured_samples) == (4, 4, 10, 2)
    again = samples.withColumn("created", F.lit("2026-10-09")).where("sample.id = 'b' and status = 'success'")
    assert runlogs.latest_runs(samples.unionByName(again)).where("metadata.provider is null").count() == 1
    runlogs.write_facts(runlogs.facts_from_logs(samples), str(tmp_path / "facts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "facts")).count() == 4


# Published spend of 795 samples per model, without and with the retries of an earlier run.
SPEND = {"qwen/qwen3.8-27b": (9.17, 812), "qwen/qwen3.6-27b": (6.48, 959), "openai/gpt-oss-20b": (0.64, 158),
         "openai/gpt-oss-120b": (1.04, 13)}


def measured(spark, retries):
    return spark.createDataFrame([(m, 795, r if retries else 0, 0, 0, 0, 0) for m, (_, r) in SPEND.items()],
                                 "model string, samples bigint, retries bigint, tokens_in bigint, tokens_out bigint, "
                                 "tokens_cached bigint, measured_samples bigint")


def test_published_spend(spark):
    usage, prices = cost.usage_table(spark), cost.price_table(spark)
    got = {r.model: round(r.usd, 2) for r in cost.spend(measured(spark, False), usage, prices).collect()}
    assert got == {m: usd for m, (usd, _) in SPEND.items()}
    total = cost.spend_with_total(cost.spend(measured(spark, True), usage, prices)).collect()
    assert total[-1].model == "**total**" and round(total[-1].usd) == 26
    assert [r.model for r in total[:-1]] == sorted(SPEND)
    unknown = spark.createDataFrame([("new", 3, 0, 10, 10, 0, 1), ("unmeasured", 3, 0, 0, 0, 0, 0)], measured(spark, True).schema)
    assert {r.model: r.usd for r in cost.spend(unknown, usage, prices).collect()} == {"new": 0.0, "unmeasured": None}


def test_published_request_costs(spark):
    usage, prices = cost.usage_table(spark), cost.price_table(spark)
    rows = {r.model: r for r in cost.requests_per_dollar(cost.request_cost(usage, prices)).collect()}
    assert round(rows["qwen/qwen3.8-27b"].usd, 4) == 0.0115 and round(rows["openai/gpt-oss-20b"].per_dollar) == 1241
    cohort = cost.cohort_table(cost.request_cost(usage, prices, fv.HISTORY_FACTOR), fv.MATRIX_MODELS)
    table = {r.scenario: [round(r[m]) for m in fv.MATRIX_MODELS] for r in cohort.collect()}
    assert table == {"light": [88, 62, 6, 10], "medium": [264, 185, 17, 29], "heavy": [660, 464, 41, 73]}
    limits = {r.model: tuple(r)[1:] for r in cost.rate_limits(usage).collect()}
    assert limits["qwen/qwen3.8-27b"] == (13294, 15, False, 18) and limits["openai/gpt-oss-120b"] == (9094, 21, False, 27)
    assert cost.burst_tokens(usage, 2).where("model = 'openai/gpt-oss-120b'").first().tokens_per_minute == 18188


def test_matrix(spark):
    from tablegauge import corpus

    samples = spark.createDataFrame([(d, f"{d}:{s['intent']}:{i}") for d, specs in corpus.INTENTS.items() for s in specs
                                     for i in range(len(s["phrasings"]))], "dataset string, id string")
    configs = matrix.config_table(spark)
    expected = matrix.expected_cells(samples, configs, fv.MATRIX_MODELS, 3)
    assert expected.count() == 3180
    run_cells = expected.where("not (model = 'openai/gpt-oss-20b' and epoch = 2)")
    keys = ["dataset", "config", "model", "sample", "epoch"]
    assert matrix.missing_cells(expected, run_cells.unionByName(run_cells), keys).count() == 265
    asked = spark.createDataFrame([("crashes", "datadesc"), ("crashes", "format")], "dataset string, config string")
    assert matrix.undefined_cells(asked, configs).count() == 1
    assert {r.config for r in configs.where("demands_format").collect()} == {"format", "format_query"}


def test_loaded_table_has_no_nan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("age,name\n1.0,a\nNaN,b\n20.0,c\n")
    frame = tables.load_table(spark, str(tmp_path / "t.csv"), "csv", "age double, name string", header="true")
    assert tuple(frame.selectExpr("count(age)", "avg(age)", "count_if(age > 16)").first()) == (2, 10.5, 1)


def test_registry(spark):
    registry = tables.Registry(spark)
    assert registry.names() == ["crashes"] and registry.metric["crashes"] == "survived_crash"
    assert registry.table("crashes") is registry.table("crashes")
    sums = registry.table("crashes").frame.selectExpr("count(*)", "sum(age)", "sum(survived_crash)").first()
    ages = [*range(20, 50), *range(25, 45), *range(18, 68)]
    assert tuple(sums) == (100, sum(ages), 58)
