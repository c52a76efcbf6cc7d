"""Run logs in, facts and report tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions import errors, tools
from tablegauge.operators.lookup import lookup
from tablegauge.sources.schemas import FLAT_LOG_SCHEMA, RUN_LOG_SCHEMA


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Run logs as JSON lines, one log per line, of any status."""
    return spark.read.schema(RUN_LOG_SCHEMA).json(path)


def read_flat_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Run logs as JSON lines, one sample per line: the layout to use when single logs are huge."""
    return spark.read.schema(FLAT_LOG_SCHEMA).json(path)


def log_samples(logs: DataFrame) -> DataFrame:
    """One row per sample of nested logs, header columns repeated."""
    return logs.select("status", "created", "epochs", "max_samples", "metadata",
                       F.explode("samples").alias("sample"))


def successful(samples: DataFrame) -> DataFrame:
    """Reports use completed logs only; empty logs have no sample rows to begin with."""
    return samples.where(F.col("status") == "success")


def model_label(model: Column, provider: Column) -> Column:
    """Short label: known alias, else the text after the last slash; other providers are appended."""
    alias = F.create_map(*[F.lit(part) for pair in fv.MODEL_LABELS.items() for part in pair])
    name = F.coalesce(model, F.lit("?"))
    label = F.coalesce(F.try_element_at(alias, name), F.substring_index(name, "/", -1))
    home = F.coalesce(provider, F.lit(fv.DEFAULT_PROVIDER)) == fv.DEFAULT_PROVIDER
    return F.when(home, label).otherwise(F.concat(label, F.lit(" @"), provider))


def score_value(letter: Column) -> Column:
    """C, I and N as 1, 0 and NULL; an absent score is NULL too."""
    return F.when(letter.isNotNull() & (letter != "N"), F.when(letter == "C", 1.0).otherwise(0.0))


def facts_from_logs(samples: DataFrame, *more: Column) -> DataFrame:
    """Scored fact rows from logged samples, with defaults for what a log leaves out, and ``more`` columns over the samples."""
    store, meta, sample = F.col("sample.store"), F.col("metadata"), F.col("sample.metadata")
    scores = F.col("sample.scores")

    def default(value: Column) -> Column:
        return F.coalesce(value, F.lit("?"))

    return samples.select(
        model_label(meta[fv.MODEL_KEY], meta["provider"]).alias("model"),
        default(meta["config"]).alias("config"), default(meta["dataset"]).alias("dataset"),
        meta["reasoning"].alias("reasoning"), sample["intent"].alias("intent"),
        sample["family"].alias("family"), F.coalesce(sample["trap"], F.lit(False)).alias("trap"),
        F.col("sample.epoch").alias("epoch"), F.col("sample.input").alias("input"),
        errors.has_error(store["error"]).alias("error"), errors.error_kind(store["error"]).alias("error_kind"),
        tools.api_calls(store["tools"]).alias("api_calls"),
        F.coalesce(store["retries"], F.lit(0)).alias("retries"),
        scores["number_honesty"]["metadata"]["verdict"].alias("honesty"),
        *[score_value(scores[name]["value"]).alias(name) for name in fv.SCORES],
        F.col("created").alias("started"), "epochs", "max_samples", *more)


def usage_from_logs(samples: DataFrame) -> DataFrame:
    """Token counts per logged sample under the full model name, for any log status."""
    store = F.col("sample.store")
    return samples.select(F.col(f"metadata.{fv.MODEL_KEY}").alias("model"), store["retries"].alias("retries"),
                          store["tokens_in"].alias("tokens_in"), store["tokens_out"].alias("tokens_out"),
                          store["tokens_cached"].alias("tokens_cached"))


_CELL = (fv.MODEL_KEY, "provider", "config", "dataset", "reasoning")


def start_time(column: str) -> Column:
    """When a log was begun; logs that do not tell it are older than all that do."""
    return F.coalesce(F.expr(f"try_cast(`{column}` as timestamp)"), F.lit("0001-01-01").cast("timestamp"))


def run_key() -> Column:
    """What logs of the same cell of the run matrix have in common."""
    return F.to_json(F.struct(*[f"metadata.{c}" for c in _CELL]))


def latest_runs(samples: DataFrame) -> DataFrame:
    """Keep the newest log of each cell where a cell was run again.

    The newest start per cell is a small aggregate; it is joined back instead of sorting samples.
    """
    keyed = samples.withColumns({"_cell": run_key(), "_at": start_time("created")})
    newest = keyed.groupBy("_cell").agg(F.max("_at").alias("_newest"))
    found = lookup(keyed, newest, ["_cell"], ["sample.id", "sample.epoch"], "newest-runs")
    return found.where(F.col("_at") == F.col("_newest")).select(*samples.columns)


def write_facts(facts: DataFrame, path: str, source: str = "csv", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    """Scored facts as CSV with a header, or in another format; partition large ones by
    the columns reports select on, such as data set and config."""
    facts.write.mode(mode).partitionBy(*partition_by).option("header", True).format(source).save(path)


def write_reports(tables: dict[str, DataFrame], path: str, source: str = "parquet",
                  mode: str = "errorifexists") -> None:
    """Each report table in its own folder."""
    for name, table in tables.items():
        table.write.mode(mode).option("header", True).format(source).save(f"{path}/{name}")
