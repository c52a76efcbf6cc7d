"""Samples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.sources.schemas import SAMPLE_SCHEMA, TARGET_SCHEMA


def read_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines samples with a declared schema; the target text is also parsed to ``truth``."""
    raw = spark.read.schema(SAMPLE_SCHEMA).json(path)
    return raw.withColumn("truth", F.from_json("target", TARGET_SCHEMA))


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one folder per dataset."""
    (samples.select("id", "input", "target", "metadata", F.col("metadata.dataset").alias("dataset"))
     .write.mode(mode).partitionBy("dataset").json(path))


def flattened(samples: DataFrame) -> DataFrame:
    """Sample metadata as top-level columns, as scoring needs them."""
    return samples.select("id", "input", "metadata.*")
