"""Shared folder for intermediate tables.

On a cluster the folder is the one named by ``spark.checkpoint.dir``, which every
executor can reach. Only a local session without that setting gets a temporary one.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tablegauge-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh, unused path below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_intermediates(spark: SparkSession) -> int:
    """Delete all tables that this application wrote below the shared folder, on whatever file system; how many there were.

    Results are lazy and read them, so a caller does this when all results are stored or collected.
    """
    paths, removed = _made.pop(spark.sparkContext.applicationId, []), 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds, as a constant of the plan: no Python worker reads it."""
    told = json.dumps(rows, default=str)
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(told), f"array<struct<{schema}>>")))


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Apply session settings for a moment and put the earlier ones back."""
    earlier = {key: spark.conf.get(key, None) for key in settings}
    changed = [key for key, value in settings.items() if earlier[key] != value]
    try:
        for key in changed:
            spark.conf.set(key, settings[key])
        yield
    finally:
        for key in changed:
            value = earlier[key]
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
