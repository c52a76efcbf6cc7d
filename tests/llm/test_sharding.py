"""Even shards on hot sources, ties and odd tables."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import sharding


def answer(frame, shards):
    return sharding.shard(frame, shards).collect()


def holds(rows, shards):
    for number in range(shards):
        assert sorted(r.slot for r in rows if r.shard == number) == list(range(sum(r.shard == number for r in rows)))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_even(spark, shards):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.xxhash64("id") % 200 + 250).cast("int")).alias("text"),
                                    F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
                                    F.lit(1).alias("SHARD"))
    rows = answer(docs.repartition(5), shards)
    holds(rows, shards)
    sums = [sum(r.size for r in rows if r.shard == n) for n in range(shards)]
    assert len(rows) == 8000 and max(sums) - min(sums) <= 4 * max(r.size for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_equal_rows_and_nulls(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "ab"), (3, "é" * 10), (4, "x" * 100_000)] + [(5, "same")] * 300
    got = answer(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    holds(got, 4)


@pytest.mark.parametrize("rows", [[(None, "same")] * 2000, [(i % 5, "text") for i in range(2000)], [(None, None)] * 2000])
def test_equal_rows_are_spread(spark, rows):
    """However many rows are equal, no shard has more than a few rows beyond its part."""
    got = answer(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40)
    holds(got, 40)
    counts = [sum(r.shard == n for r in got) for n in range(40)]
    assert sum(counts) == 2000 and 44 <= min(counts) and max(counts) <= 56


def test_empty(spark):
    assert answer(spark.createDataFrame([], "doc_id long, text string"), 40) == []


def test_native(spark):
    plan = sharding.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2)
    shown = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert not [name for name in ("Python", "Pandas", "Arrow") if name in shown]


def test_no_python_outside_the_plan(spark):
    """Neither the result nor the small tables of a level that it is made with are read by Python workers."""
    rows = sharding.keyed(sharding.metadata(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))))
    cuts = sharding._small(rows, [(0, 1, 2**63 - 1, 20), (20, 3, 5, 1)], "cut long, step int")
    assert "PythonRDD" not in cuts._jdf.queryExecution().toRdd().toDebugString()
    assert [tuple(row) for row in cuts.orderBy("node").collect()] == [(0, 1, 2**63 - 1, 20), (20, 3, 5, 1)]
    goals = sharding._small(rows, [(0, 0, 1, 9, 3, 0.1 + 0.2)], "start long, last long, width long, goal double")
    assert goals.first()["goal"] == 0.1 + 0.2 and goals.schema.simpleString().endswith("goal:double>")
