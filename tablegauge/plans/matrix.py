"""Run matrix: the cells a full comparison needs, and which of them were run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv


def config_table(spark: SparkSession, configs: Mapping[str, Sequence[str]] = fv.CONFIGS_BY_DATASET) -> DataFrame:
    """Configs defined per dataset; ``demands_format`` marks those with a reply template."""
    rows = [(d, c, c in fv.FORMAT_CONFIGS) for d, names in configs.items() for c in names]
    return spark.createDataFrame(rows, "dataset string, config string, demands_format boolean")


def expected_cells(samples: DataFrame, configs: DataFrame, models: Sequence[str], epochs: int) -> DataFrame:
    """Models x configs of the sample's dataset x samples x epochs.

    Models and epochs are short lists that multiply each row in place; only the configs
    need a join, on the dataset.
    """
    return (samples.select("dataset", F.col("id").alias("sample")).join(configs.select("dataset", "config"), "dataset")
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
            .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))))


def undefined_cells(requested: DataFrame, configs: DataFrame) -> DataFrame:
    """Requested (dataset, config) pairs that are not defined."""
    return requested.select("dataset", "config").distinct().join(configs, ["dataset", "config"], "left_anti")


def missing_cells(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected cells without any observed run. Both sides are made distinct first, so a cell
    run a billion times is one row in the join."""
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), list(keys), "left_anti")


def epoch_spread(facts: DataFrame, score: str) -> DataFrame:
    """Accuracy per cell over all epochs with the spread between epochs."""
    by_epoch = facts.groupBy("model", "config", "epoch").agg(F.sum(score).alias("s"), F.count(score).alias("n"))
    return by_epoch.where(F.col("n") > 0).groupBy("model", "config").agg(
        (F.sum("s") / F.sum("n")).alias("accuracy"), F.count(F.lit(1)).alias("epochs"),
        F.min(F.col("s") / F.col("n")).alias("lowest_epoch"), F.max(F.col("s") / F.col("n")).alias("highest_epoch"))


def compare_settings(facts: DataFrame, setting: str, cell: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means of measures per value of one run setting within each cell; the setting stays a key."""
    return facts.groupBy(*cell, setting).agg(F.count(F.lit(1)).alias("requests"),
                                             *[F.avg(m).alias(m) for m in measures])
