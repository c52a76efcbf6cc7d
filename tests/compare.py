"""Compare registered queries with their SQL on DuckDB.

Run as ``python tests/compare.py [sf_dir] [name ...]`` to print every difference.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    """One representation per value, whatever the engine's type for it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r)))


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def duck_table(connection, sql):
    result = connection.execute(sql)
    return table_of([d[0] for d in result.description], result.fetchall())


def close(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and not isinstance(a, str) and not isinstance(b, str) \
            and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def differences(left, right, limit: int = 3) -> list[str]:
    if left[0] != right[0]:
        return [f"columns {left[0]} != {right[0]}"]
    if len(left[1]) != len(right[1]):
        return [f"rows {len(left[1])} != {len(right[1])}", f"spark {left[1][:limit]}", f"duck {right[1][:limit]}"]
    bad = [(a, b) for a, b in zip(left[1], right[1]) if not all(map(close, a, b))]
    notes = [f"{a} != {b}" for a, b in bad[:limit]]
    if not bad:
        inexact = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        types = {(type(x).__name__, type(y).__name__) for a, b in zip(left[1], right[1]) for x, y in zip(a, b)
                 if type(x) is not type(y)}
        if inexact:
            notes.append(f"inexact {inexact[0]}")
        if types:
            notes.append(f"types {types}")
    return notes


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            mine = spark_table(run(spark, sf_dir))
            took = time.time() - started
            notes = differences(mine, duck_table(connection, oracles[name])) if name in oracles else ["no SQL"]
        except Exception as fault:
            took, notes, mine = time.time() - started, [f"{type(fault).__name__}: {str(fault)[:600]}"], ([], [])
        failed += bool(notes)
        print(f"{'ok ' if not notes else 'BAD'} {name} rows={len(mine[1])} {took:.2f}s", *notes, sep="\n    " if notes else " ")
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
