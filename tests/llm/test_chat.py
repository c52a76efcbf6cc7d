"""Windows: budget, history, masks, escapes and odd tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablegauge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def windows(spark, rows, budget=chat.Budget()):
    made = chat.windows(spark.createDataFrame(rows, SCHEMA).withColumn("WINDOW", F.lit(1)), budget)
    read = made.withColumns({"turns": chat.read_turns(F.col("text"), F.col("n_repeated")), "targets": chat.read_targets(F.col("text"), F.col("loss"))})
    return sorted(read.collect(), key=lambda r: (repr(r.conv_id), r.window))


def test_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "\\", "\\b\\h\\l\\c", "a\n</turn>\n### user: b", "#<:\\", "é😀 " * 5000]
    rows = [(1, i, ["user", "assistant", "a: b", None][i % 4], t) for i, t in enumerate(odd)] + [(None, None, "assistant", "x")] * 2
    by_conv: dict = {}
    for r in windows(spark, rows):
        by_conv.setdefault(r.conv_id, []).append(r)
    said = [(t.role, t.text) for r in by_conv[1] for t in r.turns]
    assert said == [(role or "", text or "") for _, _, role, text in rows[:-2]]
    assert [t for r in by_conv[1] for t in r.targets] == [t or "" for _, _, role, t in rows[:-2] if role == "assistant"]
    assert [t for r in by_conv[None] for t in r.targets] == ["x", "x"]


def test_budget(spark):
    rows = [(1, i, "system" if i == 0 else "assistant" if i % 2 else "user", f"w{i} " * (20 + i * 7 % 30)) for i in range(60)] + [
        (1, 60, "assistant", "long " * 900), (1, 61, "user", "end")]
    budget = chat.Budget(200, 60, 2)
    got = windows(spark, rows, budget)
    assert [t.text for r in got for t in r.turns] == [text for *_, text in rows]
    assert [t for r in got for t in r.targets] == [text for _, _, role, text in rows if role == "assistant"]
    for r in got:
        tokens = len(re.findall(r"\w+|[^\w\s]", r.text))
        assert tokens <= budget.tokens or len(r.turns) == 1
        assert r.window == 0 or r.text.startswith("### system: w0") and 1 <= r.n_repeated <= 3
    assert len(got) > 10


def test_empty(spark):
    assert windows(spark, []) == []
