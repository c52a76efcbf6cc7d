"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from catalog import ORACLES, QUERIES
from tests.compare import connect, differences, duck_table, spark_table

SF_DIR = "/root/testdata/sf0.001"

# Python workers and joins without keys have no place in any plan.
UNWANTED = ["EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"]
# Rows are not sorted to aggregate them, but for smallest and largest texts in the profile of a whole table.
SORTED = {"D4_schema_profile", "D5_described_columns"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    mine = spark_table(frame)
    plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")
    assert not [bad for bad in UNWANTED if bad in plan] and ("SortAggregate" not in plan or name in SORTED)
    assert differences(mine, duck_table(duck, ORACLES[name])) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
