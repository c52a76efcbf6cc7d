"""From logged conversations to scored facts.

Everything between the log and the facts is one lazy plan; the only step that runs
ahead of it is counting the rows of the distinct generated statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions import errors
from tablegauge.operators import extract, scoring
from tablegauge.operators.lookup import lookup
from tablegauge.operators.statements import (
    Binding,
    count_statements,
    distinct_statements,
    with_statement_counts,
)
from tablegauge.sources.samples import flattened
from tablegauge.workdir import written

# What identifies a request; several attempts of one request differ in ``attempt`` only.
REQUEST = ["model", "provider", "reasoning", "config", "sample_id", "epoch"]


def run_table(conversations: DataFrame, max_retries: int | None = None) -> DataFrame:
    """One run per request from logged attempts: the attempt that counts is chosen by its error, and it alone is extracted."""
    told = conversations.withColumn("_error", errors.error_text(F.col("error_type"), F.col("error_message")))
    kept = extract.kept_attempts(told, REQUEST, error="_error", max_retries=max_retries)
    return extract.run_results(kept.drop("_error"))


def with_samples(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Add each run's sample: its text, family, expected tools and truth."""
    described = flattened(samples).drop("truth_sql", "variant", "rate").withColumnRenamed("id", "sample_id")
    return lookup(runs, described, ["sample_id"], ["model", "config", "epoch"], "samples")


def score_conversations(conversations: DataFrame, samples: DataFrame, tables: dict[str, Binding], *,
                        suggestion_datasets: list[str] = fv.SUGGESTION_DATASETS, strict: bool = False) -> DataFrame:
    """Scored runs of logged conversations over the bound tables.

    ``conversations`` holds the columns of ``REQUEST``, ``attempt``, ``started`` and what
    ``run_results`` expects. The runs are written down once, because their statements are
    counted first and the runs are scored after that.
    """
    runs = written(with_samples(run_table(conversations), samples), "runs")
    filters = runs.where(F.col("family") == "filter")
    counts = count_statements(distinct_statements(filters, "dataset", "update_sql"), tables, strict=strict)
    counted = with_statement_counts(runs, counts, "dataset", "update_sql", spread_by=REQUEST)
    return scoring.score_runs(counted, "statement_rows", suggestion_datasets)
