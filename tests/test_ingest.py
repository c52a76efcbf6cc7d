"""Stores of run logs: every log once, repeated batches, replaced runs, logs of several, no and failed samples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.plans import report
from tablegauge.sources import ingest, runlogs


def log(config="baseline", created="2024-01-01T00:00:00", status="success", samples=((1, "C"),), model="vendor/m1"):
    return {"status": status, "created": created, "epochs": 2, "max_samples": 8,
            "metadata": {fv.MODEL_KEY: model, "provider": None, "config": config, "dataset": "d", "reasoning": None},
            "samples": [{"id": f"s{i}", "input": f"ask {i}", "epoch": 1 + i % 2,
                         "metadata": {"dataset": "d", "intent": f"i{i % 5}", "family": "filter", "trap": False},
                         "store": {"tools": ["a", "b"], "retries": 1, "error": "TimeoutError: x" if i % 4 == 0 else None},
                         "scores": {"tool_choice": {"value": letter}}} for i, letter in samples]}


def put(folder, name, *logs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, logs)) + "\n")


@pytest.fixture
def places(tmp_path):
    return tmp_path / "logs", str(tmp_path / "store")


def full_pass(spark, store, keys):
    """The cells that one pass over all stored facts gives."""
    facts = runlogs.facts_from_logs(runlogs.latest_runs(runlogs.successful(ingest.stored_samples(spark, store))))
    return report.cells(facts, keys)


def rows(cells, keys):
    return sorted((tuple(r[k] for k in keys), r.requests, r.errors, r.api_calls, r.retries, r.sum_tool_choice, r.n_tool_choice)
                  for r in cells.collect())


def test_each_log_is_read_once(spark, places):
    logs, store = places
    put(logs, "a.json", log(), log("format", samples=[(i, "CIN"[i % 3]) for i in range(9)]))
    put(logs, "b.json", log(status="error"), log("datadesc", samples=[]))
    assert ingest.ingest(spark, str(logs), store) == 4
    assert ingest.ingest(spark, str(logs), store) == 0
    put(logs, "c.json", log("format_query", samples=[(3, "I")]))
    assert ingest.ingest(spark, str(logs), store) == 1
    assert ingest.stored_samples(spark, store).count() == 12
    keys = ["model", "config"]
    merged = rows(ingest.kept_cells(spark, store, keys), keys)
    assert merged == rows(full_pass(spark, store, keys), keys)
    assert [(r[0][1], r[1]) for r in merged] == [("baseline", 1), ("format", 9), ("format_query", 1)]


def test_newer_logs_replace_a_run(spark, places):
    logs, store = places
    put(logs, "a.json", log(samples=[(1, "I"), (2, "I")]), log("format"))
    ingest.ingest(spark, str(logs), store)
    put(logs, "b.json", log(created="2024-02-01T00:00:00", samples=[(1, "C")]), log("format", created="2023-01-01T00:00:00", samples=[(7, "I")]),
        log(created="2024-03-01T00:00:00", status="error"), log(created=None, samples=[(5, "I")]))
    ingest.ingest(spark, str(logs), store)
    keys = ["config", "dataset", "family"]
    assert rows(ingest.kept_cells(spark, store, keys), keys) == rows(full_pass(spark, store, keys), keys) == [
        (("baseline", "d", "filter"), 1, 0, 3, 1, 1.0, 1), (("format", "d", "filter"), 1, 0, 3, 1, 1.0, 1)]


def test_a_repeated_batch_adds_nothing(spark, places):
    """A batch that failed after its samples were written is written again, not added."""
    logs, store = places
    put(logs, "a.json", log(samples=[(i, "C") for i in range(6)]))
    half = runlogs.log_samples(runlogs.read_logs(spark, str(logs))).limit(3)
    half.write.parquet(f"{store}/samples/batch=0")
    ingest.ingest(spark, str(logs), store)
    assert ingest.stored_samples(spark, store).count() == 6
    assert ingest.kept_cells(spark, store, ["model"]).first().requests == 6


def test_small_batches(spark, places):
    logs, store = places
    for i in range(5):
        put(logs, f"{i}.json", log(f"c{i}", samples=[(i, "C"), (i + 1, "I")]))
    assert ingest.ingest(spark, str(logs), store, logs_a_batch=2) == 5
    keys = ["config"]
    assert rows(ingest.kept_cells(spark, store, keys), keys) == rows(full_pass(spark, store, keys), keys)
    assert ingest.kept_cells(spark, store, keys).count() == 5


def test_sketches(spark, places):
    """Distinct counts of unions, within five standard errors, and exact for few."""
    logs, store = places
    many = [(i, "C") for i in range(6000)]
    put(logs, "a.json", log(samples=many[:4000]), log("format", samples=many[2000:]))
    ingest.ingest(spark, str(logs), store)
    put(logs, "b.json", log("datadesc", samples=many[:100]))
    ingest.ingest(spark, str(logs), store)
    kept = ingest.kept_cells(spark, store, [*report.DIMENSIONS, "first_epoch", "started"])
    facts = runlogs.facts_from_logs(runlogs.latest_runs(runlogs.successful(ingest.stored_samples(spark, store))))
    exact, estimate = report.family_coverage(facts).first(), ingest.family_coverage(kept).first()
    assert (exact.intents, exact.phrasings) == (5, 3000) and estimate.intents == 5
    assert abs(estimate.phrasings - 3000) <= 5 * 0.016 * 3000
    run, guess = report.run_facts(facts).first(), ingest.run_facts(kept).first()
    assert (run.first_date, run.models, run.configs, run.requests) == (guess.first_date, guess.models, guess.configs, guess.requests)
    assert abs(guess.phrasings - run.phrasings) <= 5 * 0.016 * run.phrasings


def test_reports_from_kept_cells(spark, places):
    """The tables of a report are the same from kept cells and from all facts."""
    logs, store = places
    put(logs, "a.json", log(samples=[(i, "CIN"[i % 3]) for i in range(20)]), log("format", samples=[(i, "CI"[i % 2]) for i in range(20)]))
    ingest.ingest(spark, str(logs), store)
    kept, whole = ingest.kept_cells(spark, store), full_pass(spark, store, report.DIMENSIONS)
    for table in (lambda c: report.accuracy_table(c, "tool_choice"), report.error_kinds, report.volume, report.error_rate):
        assert sorted(map(tuple, table(kept).collect()), key=repr) == sorted(map(tuple, table(whole).collect()), key=repr)
    assert kept.select(F.sum("requests")).first()[0] == 40
