"""Analysed tables: loading, the synthetic crashes table, lookup by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge import fixed_values as fv
from tablegauge.operators.statements import Binding, bind
from tablegauge.sources.schemas import PASSENGER_SCHEMA


def nan_to_null(frame: DataFrame) -> DataFrame:
    """Missing numbers as NULL on every floating column, so predicates and means skip them."""
    return frame.select(*[
        F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in frame.schema.fields])


def load_table(spark: SparkSession, path: str, source: str = "parquet", schema: str | None = None,
               **options: str) -> DataFrame:
    """Read an analysed table; CSV files need a schema because inferring one reads all data twice."""
    reader = spark.read.format(source).options(**options)
    if schema:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def segment_value(position: Column, segments: Sequence[tuple]) -> Column:
    """Value at a row position of a column given as (value, length) runs."""
    end, result = 0, None
    for value, length in segments:
        end += length
        result = (F if result is None else result).when(position < end, F.lit(value))
    return result


def segment_ramp(position: Column, ramps: Sequence[tuple[int, int]]) -> Column:
    """Value at a row position of a column given as (first value, length) ascending runs."""
    start, result = 0, None
    for first, length in ramps:
        value = (position - start + first).cast("int")
        start += length
        result = (F if result is None else result).when(position < start, value)
    return result


def with_crash_columns(frame: DataFrame, position: Column) -> DataFrame:
    """Columns of the crashes table by row position, as plain expressions without a join."""
    return frame.select(
        "*",
        segment_value(position, fv.CRASH_PLANETS).alias("planet"),
        segment_value(position, fv.CRASH_SURVIVED).alias("survived_crash"),
        segment_value(position, fv.CRASH_ROLES).alias("crew_role"),
        segment_ramp(position, fv.CRASH_AGES).alias("age"))


def crashes(spark: SparkSession) -> DataFrame:
    """The synthetic planet-crash table, 100 rows."""
    rows = sum(length for _, length in fv.CRASH_PLANETS)
    return with_crash_columns(spark.range(rows), F.col("id")).drop("id")


class Registry:
    """Tables and their 0/1 metric columns by name; each is loaded and bound once.

    ``passengers`` is the path of the passenger table as CSV, if it is at hand.
    """

    def __init__(self, spark: SparkSession, passengers: str | None = None) -> None:
        self._loaders: dict[str, Callable[[], DataFrame]] = {}
        self._bound: dict[str, Binding] = {}
        self._kept: list[DataFrame] = []
        self.metric: dict[str, str] = {}
        self.add("crashes", lambda: crashes(spark), fv.METRIC_COLUMN["crashes"])
        if passengers:
            self.add("titanic", lambda: load_table(spark, passengers, "csv", PASSENGER_SCHEMA, header="true"),
                     fv.METRIC_COLUMN["titanic"])

    def add(self, name: str, loader: Callable[[], DataFrame], metric: str) -> None:
        self._loaders[name], self.metric[name] = loader, metric
        self._bound.pop(name, None)

    def table(self, name: str, keep: bool = False) -> Binding:
        """Bound table; ``keep`` persists it for many scorings of one session."""
        if name not in self._bound:
            frame = self._loaders[name]()
            if keep:
                self._kept.append(frame.persist())
            self._bound[name] = bind(frame, name)
        return self._bound[name]

    def close(self) -> None:
        """Release persisted tables and the sessions of all bound ones."""
        for frame in self._kept:
            frame.unpersist()
        self._kept, self._bound = [], {}

    def __enter__(self) -> Registry:
        return self

    def __exit__(self, *failure: object) -> None:
        self.close()

    def names(self) -> list[str]:
        return list(self._loaders)
