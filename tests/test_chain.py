"""Logged conversations of the chain: both attempts of a request from one row."""

from __future__ import annotations

import datetime

from catalog import chain_queries


def test_attempts_come_from_one_row(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(i, i % 5, kind, at, 1.5 * i, f'{{"k": {i}}}')
            for i, kind in enumerate(["signup", "purchase", "click", "error", "view", "error", "click", None])] + [(None, 1, "click", at, 1.0, '{"k": 3}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    logged = chain_queries.logged_conversations(spark, str(tmp_path))
    plan = logged._sc._jvm.PythonSQLUtils.explainString(logged._jdf.queryExecution(), "simple")
    assert plan.count("FileScan") == 2  # a second pair of scans and joins made the early attempts before
    got = {(r.run_id, r.attempt): r for r in logged.collect()}
    assert sorted(got) == sorted([(i, 0) for i in range(8)] + [(i, 1) for i in (0, 3, 6)])
    for i in (0, 3, 6):
        early, last = got[i, 0], got[i, 1]
        assert (early.error_type, early.error_message, early.updates) == ("RateLimitError", "try again in 5s", ["SELECT 0"])
        assert last.updates != ["SELECT 0"] and last.error_type != "RateLimitError" and early.turns == last.turns
    assert got[3, 1].error_type is not None and got[5, 0].error_type is not None and got[1, 0].error_type is None
