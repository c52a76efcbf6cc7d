"""Dashboard over one table: filter, query, reset, schema, dictionary, title."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge import fixed_values as fv
from tablegauge.operators.extract import first_of_each
from tablegauge.operators.statements import bind, run_statement


class Dashboard:
    """The view of one table that filters replace and a reset restores.

    Everything returned is lazy. Statements are read-only queries on the table's name.
    """

    def __init__(self, frame: DataFrame, name: str, default_title: str | None = None) -> None:
        self.table = bind(frame, name)
        self.default_title = default_title or f"{name} dataset"
        self.reset()

    def filter(self, sql: str, title: str | None = None) -> DataFrame:
        """Replace the view by the rows a query returns; the view stays as it was if the query is faulty."""
        self.view = run_statement(sql, self.table)
        self._title = title
        return self.view

    def query(self, sql: str) -> DataFrame:
        """Rows of an ad-hoc query; the view does not change."""
        return run_statement(sql, self.table)

    def scalar(self, sql: str):
        """First value of an ad-hoc query, None when it has no row."""
        row = self.query(sql).first()
        return None if row is None else row[0]

    def reset(self) -> DataFrame:
        """Drop the filter and show every row."""
        self.view, self._title = self.table.frame, None
        return self.view

    def title(self) -> str:
        return self._title or self.default_title

    def replay(self, calls: Iterable[tuple[str, str | None]]) -> DataFrame:
        """Apply (tool, statement) calls in order; only the last filter or reset decides the view,
        so superseded filters are never analysed."""
        last = None
        for tool, sql in calls:
            if tool in (fv.UPDATE_TOOL, fv.RESET_TOOL):
                last = (tool, sql)
        if last is None:
            return self.view
        return self.filter(last[1]) if last[0] == fv.UPDATE_TOOL else self.reset()

    def schema(self, exact: bool = False) -> DataFrame:
        return profile(self.table.frame, exact)


def title_or_default(title: Column, default: str) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(default))


def last_updates(calls: DataFrame, group: list[str], statement: str, position: str) -> DataFrame:
    """The statement that each group sent last, NULL where it sent none; NULL statements do not count."""
    rows = calls.select(*group, statement, position)
    return first_of_each(rows, group, F.col(statement).isNull(), F.desc(position)).drop(position)


def profile(frame: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: type, meaning, filled rows, distinct values, smallest and largest value.

    A single pass with fixed-size states; distinct values are estimated unless exact
    numbers are asked for, which costs a shuffle of the values.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    rows = []
    for field in frame.schema.fields:
        value = F.col(f"`{field.name}`")
        ordered = not isinstance(field.dataType, (T.MapType, T.VariantType))
        rows.append(F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.metadata.get("comment")).cast("string").alias("meaning"),
            F.count(value).alias("filled"),
            (distinct(value) if ordered else F.lit(None).cast("bigint")).alias("distinct_values"),
            _text(F.min(value), field.dataType).alias("smallest") if ordered else F.lit(None).cast("string").alias("smallest"),
            _text(F.max(value), field.dataType).alias("largest") if ordered else F.lit(None).cast("string").alias("largest")))
    return frame.agg(F.array(*rows).alias("columns")).select(F.explode("columns").alias("c")).select("c.*")


def _text(value: Column, data_type: T.DataType) -> Column:
    return F.to_json(value) if isinstance(data_type, (T.ArrayType, T.StructType)) else value.cast("string")


def vocabulary_values(frame: DataFrame, limit: int = 20) -> DataFrame:
    """Real values, with row counts, of the text and boolean columns that have at most ``limit`` of them.

    A first pass of fixed-size sketches drops the columns that clearly have more, so long
    texts are never shuffled; the second groups only the remaining columns' values.
    """
    names = [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    schema = "column_name string, value string, n bigint"
    if not names:
        return frame.sparkSession.createDataFrame([], schema)
    estimates = frame.agg(*[F.approx_count_distinct(f"`{c}`", 0.02).alias(c) for c in names]).first()
    names = [c for c in names if estimates[c] <= limit * 1.2 + 1]
    if not names:
        return frame.sparkSession.createDataFrame([], schema)
    pairs = frame.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names
    ])).alias("p")).select("p.*").where(F.col("value").isNotNull())
    counted = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= limit)
    return counted.join(sizes, "column_name", "left_semi")


def with_meanings(frame: DataFrame, meanings: dict[str, str]) -> DataFrame:
    """Attach the meaning of columns as metadata; ``profile`` and table comments show it."""
    for column, meaning in meanings.items():
        if column in frame.columns:
            frame = frame.withMetadata(column, {**frame.schema[column].metadata, "comment": meaning})
    return frame


def dictionary(frame: DataFrame) -> DataFrame:
    """Column names, types and meanings as a table."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in frame.schema.fields]
    return frame.sparkSession.createDataFrame(rows, "column_name string, type string, meaning string")
