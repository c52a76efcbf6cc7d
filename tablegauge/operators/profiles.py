"""Profiles of columns that are kept beside the data and merged, one state for each column of a file, day or batch.

A state holds counts and sketches of a fixed size: distinct values (HLL), quantiles of numbers (KLL), most frequent values
(top-k). States of parts make the state of the whole, so a profile of a grown table reads the new part only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_SIZE = 12  # 2**12 registers: 1.6 % standard error of a number of distinct values, exact for a few hundred
QUANTILE_SIZE = 200  # about 1.7 % error in rank
TRACKED = 1000  # values that are followed; counts of up to 750 distinct ones are exact
SHOWN_LENGTH = 100  # characters of a value that are kept

_KEYS = ["column_name", "type", "meaning"]


def profile_state(frame: DataFrame) -> DataFrame:
    """One row a column: counts of rows and filled rows, and the sketches, in one pass. Maps are counted only."""
    rows = []
    for field in frame.schema.fields:
        value = F.col(f"`{field.name}`")
        plain = not isinstance(field.dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType))
        text = F.left(value.cast("string"), F.lit(SHOWN_LENGTH)) if plain else F.lit(None).cast("string")
        number = value.cast("double") if isinstance(field.dataType, T.NumericType) else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.metadata.get("comment")).cast("string").alias("meaning"), F.count(F.lit(1)).alias("n_rows"),
            F.count(value).alias("filled"), F.hll_sketch_agg(_whole(value, plain), SKETCH_SIZE).alias("distinct_sketch"),
            F.kll_sketch_agg_double(number, QUANTILE_SIZE).alias("quantile_sketch"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("frequent_state")))
    return frame.agg(F.array(*rows).alias("columns")).select(F.inline("columns"))


def _whole(value: Column, plain: bool) -> Column:
    return value.cast("string") if plain else F.lit(None).cast("string")


def merged(states: DataFrame) -> DataFrame:
    """States of the same columns of several parts as one."""
    return states.groupBy(*_KEYS).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("filled").alias("filled"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", QUANTILE_SIZE).alias("quantile_sketch"),
        F.call_function("approx_top_k_combine", F.col("frequent_state"), F.lit(TRACKED)).alias("frequent_state"))


def described(states: DataFrame, values: int = 10) -> DataFrame:
    """What merged states tell: filled rows, estimated distinct values, quartiles of numbers, most frequent values with counts."""
    sketch = F.col("quantile_sketch")
    quartiles = F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(
        sketch, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    return states.select(*_KEYS, "n_rows", "filled", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
                         quartiles.alias("quartiles"),
                         F.call_function("approx_top_k_estimate", F.col("frequent_state"), F.lit(values)).alias("frequent"))


def vocabulary(states: DataFrame, limit: int = 20) -> DataFrame:
    """Values, with row counts, of the columns that have at most ``limit``; of the others one row that tells their estimated number.

    Columns: column_name, distinct_values, value and n (both NULL for columns with more values).
    """
    told = described(states, limit).where("filled > 0")
    few = F.col("distinct_values") <= limit
    each = F.when(few, F.filter("frequent", lambda v: v["item"].isNotNull())).otherwise(F.lit(None))
    return told.select("column_name", "distinct_values", F.explode_outer(each).alias("v")).select(
        "column_name", "distinct_values", F.col("v.item").alias("value"), F.col("v.count").alias("n"))
