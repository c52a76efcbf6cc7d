"""Intermediate tables: written once, read again, removed on demand."""

from __future__ import annotations

from pathlib import Path

from tablegauge import workdir


def test_intermediates_are_removed(spark):
    kept = workdir.shared_folder(spark)
    workdir.remove_intermediates(spark)
    table = workdir.written(spark.range(5), "numbers")
    unused = workdir.new_path(spark, "unused")
    assert table.count() == 5 and unused.startswith(kept)
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.is_dir() and workdir.remove_intermediates(spark) == 1 and not folder.exists()
    assert workdir.remove_intermediates(spark) == 0 and Path(kept).is_dir()


def test_small_tables_keep_their_types(spark):
    rows = [{"a": 1, "b": "x\n'\"", "c": 2**70, "d": None}, {"a": None, "b": None, "c": -5, "d": 1.5}]
    table = workdir.small_table(spark, rows, "a: int, b: string, c: decimal(38,0), d: double")
    assert [tuple(r) for r in table.collect()] == [(1, "x\n'\"", 2**70, None), (None, None, -5, 1.5)]
    assert workdir.small_table(spark, [], "a: int").count() == 0
