"""Report tables over scored facts.

Every table is derived from ``cells``: counts and score sums per combination of the
dimensions a report needs. That is one pass over the facts with map-side combining;
what follows works on a few thousand rows at most. A whole report builds the cells
once and writes them down.

Long tables (model, config, value, n) are the canonical form; wide ones use fixed
column lists, so no job is needed to discover the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions.rounding import percent, ratio, round_scaled
from tablegauge.workdir import written

DIMENSIONS = ["dataset", "model", "config", "family", "trap", "error_kind", "honesty"]
COMPOSITE_SCORES = ["tool_choice", "filter_rows", "answer_correct"]


def cells(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and score sums per combination of ``keys``; unused sums are pruned by Spark."""
    return facts.groupBy(*keys).agg(*sums())


def sums() -> list[Column]:
    """The states of a cell; they add up over any two sets of facts."""
    parts = [F.count(F.lit(1)).alias("requests"), F.sum(F.col("error").cast("bigint")).alias("errors"),
             F.sum("api_calls").alias("api_calls"), F.sum("retries").alias("retries")]
    for score in fv.SCORES:
        parts += [F.sum(score).alias(f"sum_{score}"), F.count(score).alias(f"n_{score}")]
    return parts


def _mean(score: str) -> Column:
    return ratio(F.sum(f"sum_{score}"), F.sum(f"n_{score}"))


# --- accuracy tables ---------------------------------------------------------------


def accuracy_long(c: DataFrame, score: str) -> DataFrame:
    """Accuracy in whole percent per model and config over the requests the score applies to,
    with that number of requests; cells it never applies to are absent."""
    return (c.groupBy("model", "config")
            .agg(percent(_mean(score)).alias("value"), F.sum(f"n_{score}").alias("n"))
            .where(F.col("n") > 0))


def widened(long: DataFrame, value: str = "value", configs: Sequence[str] = fv.CONFIG_ORDER) -> DataFrame:
    """Model x config table with the configs in report order."""
    return long.groupBy("model").pivot("config", list(configs)).agg(F.max(value))


def accuracy_table(c: DataFrame, score: str, configs: Sequence[str] = fv.CONFIG_ORDER) -> DataFrame:
    return widened(accuracy_long(c, score), "value", configs)


def requests_per_config(c: DataFrame, score: str) -> DataFrame:
    """The n of a column: the largest number of scored requests any model has in that config."""
    return accuracy_long(c, score).groupBy("config").agg(F.max("n").alias("n"))


def present_configs(c: DataFrame, score: str, configs: Sequence[str] = fv.CONFIG_ORDER) -> DataFrame:
    """Configs that occur, with their position in report order."""
    position = F.array_position(F.array(*[F.lit(x) for x in configs]), F.col("config"))
    return accuracy_long(c, score).groupBy("config").agg(F.max("n").alias("n")).select(
        "config", position.cast("int").alias("position"), "n").where(F.col("position") > 0)


def best(table: DataFrame, column: str) -> DataFrame:
    """Model with the highest value of a column; the first by name among equals."""
    return (table.where(F.col(column).isNotNull()).orderBy(F.desc(column), "model").limit(1)
            .select("model", F.col(column).alias("value")))


# --- summary figures ---------------------------------------------------------------


def error_rate(c: DataFrame) -> DataFrame:
    """Errored requests per model in whole percent."""
    return c.groupBy("model").agg(percent(ratio(F.sum("errors"), F.sum("requests"))).alias("error_pct"))


def untrusted_share(c: DataFrame) -> DataFrame:
    """Percent of replies with wrong or unverified figures per model and config.

    Silent replies stay in the denominator; replies without a verdict do not.
    """
    bad = F.sum(F.when(F.col("honesty").isin("wrong", "unverified"), F.col("requests")).otherwise(0))
    return (c.where(F.col("honesty").isNotNull()).groupBy("model", "config")
            .agg((ratio(bad, F.sum("requests")) * 100).alias("value")))


def score_percents(c: DataFrame, scores: Sequence[str] = COMPOSITE_SCORES,
                   configs: Sequence[str] = fv.CONFIG_ORDER) -> DataFrame:
    """Several accuracy tables of the known configs in one long table (model, config, score, value), from one pass."""
    wide = c.where(F.col("config").isin(list(configs))).groupBy("model", "config").agg(*[percent(_mean(s)).alias(s) for s in scores])
    return wide.unpivot(["model", "config"], list(scores), "score", "value").where(F.col("value").isNotNull())


def _with_column_count(percents: DataFrame) -> DataFrame:
    """Percents with the number of (score, config) columns that any model has: a few rows a model, in one window."""
    from pyspark.sql import Window

    return percents.withColumn("columns", F.size(F.collect_set(F.struct("score", "config")).over(Window.partitionBy(F.lit(0)))))


def complete_models(percents: DataFrame) -> DataFrame:
    """Models that have a value for every config that occurs, in every score."""
    return (_with_column_count(percents).groupBy("model").agg(F.count("value").alias("n"), F.max("columns").alias("columns"))
            .where(F.col("n") == F.col("columns")).select("model"))


def composite(percents: DataFrame) -> DataFrame:
    """Mean over scores of the mean over configs of the rounded percents, complete models only."""
    by_score = _with_column_count(percents).groupBy("model", "score").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n"), F.max("columns").alias("columns"))
    by_model = by_score.groupBy("model").agg(F.avg("mean").alias("composite"), F.sum("n").alias("n"), F.max("columns").alias("columns"))
    return by_model.where(F.col("n") == F.col("columns")).select("model", "composite")


def ranking(composites: DataFrame) -> DataFrame:
    """Models from best to worst; equals share a rank. One row per model, so one task sorts them."""
    from pyspark.sql import Window

    return composites.select("model", "composite", F.rank().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("composite"))).alias("rank"),
        round_scaled(F.col("composite")).cast("bigint").alias("composite_pct"))


def aligned(tables: dict[str, DataFrame]) -> DataFrame:
    """Model-keyed tables side by side; a model missing in one has NULL there."""
    result = None
    for name, table in tables.items():
        renamed = table.select("model", *[F.col(x).alias(f"{name}_{x}") for x in table.columns if x != "model"])
        result = renamed if result is None else result.join(renamed, "model", "full_outer")
    return result


def column_summary(table: DataFrame, column: str) -> DataFrame:
    """Mean, smallest and largest value over models, cut to whole numbers."""
    return table.agg(*[f(column).cast("int").alias(name) for f, name in
                       ((F.avg, "mean_value"), (F.min, "min_value"), (F.max, "max_value"))])


def before_after(table: DataFrame, before: str, after: str) -> DataFrame:
    """Two columns of a wide table for the models without a gap in any column that some model has."""
    from pyspark.sql import Window

    rows = Window.partitionBy(F.lit(0))  # one row a model
    full = F.lit(True)
    for name in table.columns:
        full = full & (F.col(f"`{name}`").isNotNull() | (F.count(F.col(f"`{name}`")).over(rows) == 0))
    return table.withColumn("_full", full).where("_full").select("model", F.col(before).alias("before"), F.col(after).alias("after"))


# --- errors ------------------------------------------------------------------------


def error_volume(c: DataFrame) -> DataFrame:
    """Requests, errors and error rate with one decimal per model."""
    rate = round_scaled(ratio(F.col("errors"), F.col("requests")) * 100, 1)
    return (c.groupBy("model").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
            .withColumn("error_rate", F.concat(rate.cast("string"), F.lit("%"))))


def error_kinds(c: DataFrame) -> DataFrame:
    """Errors per model and kind, long."""
    return (c.where(F.col("error_kind").isNotNull()).groupBy("model", "error_kind")
            .agg(F.sum("errors").alias("n")))


MOST_KINDS = 40


def found_kinds(c: DataFrame, most: int = MOST_KINDS) -> tuple[list[str], bool]:
    """The most frequent error kinds by name, and whether there are more; each becomes a column."""
    counted = c.where(F.col("error_kind").isNotNull()).groupBy("error_kind").agg(F.sum("errors").alias("n"))
    rows = counted.orderBy(F.desc("n"), "error_kind").limit(most + 1).collect()
    return sorted(row.error_kind for row in rows[:most]), len(rows) > most


def error_table(c: DataFrame, kinds: Sequence[str] | None = None, other: str = "other", most: int = MOST_KINDS) -> DataFrame:
    """Error volume with one zero-filled column per kind, in one aggregation.

    Without ``kinds`` the ``most`` most frequent kinds have a column. Kinds that are not named, or beyond those, are summed
    in ``other``, so that the columns always add up to ``errors``.
    """
    kinds, named = found_kinds(c, most) if kinds is None else (list(kinds), True)
    counts = [F.coalesce(F.sum(F.when(F.col("error_kind") == k, F.col("errors"))), F.lit(0)).alias(k)
              for k in kinds]
    if named:
        rest = F.coalesce(F.sum(F.when(~F.coalesce(F.col("error_kind"), F.lit("")).isin(kinds), F.col("errors"))), F.lit(0))
        kinds, counts = [*kinds, other], [*counts, rest.alias(other)]
    totals = c.groupBy("model").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), *counts)
    rate = round_scaled(ratio(F.col("errors"), F.col("requests")) * 100, 1)
    return totals.select("model", "requests", "errors",
                         F.concat(rate.cast("string"), F.lit("%")).alias("error_rate"),
                         *[F.col("`" + k.replace("`", "``") + "`") for k in kinds])


# --- what was tested ---------------------------------------------------------------


def family_coverage(facts: DataFrame, epoch: int = 1) -> DataFrame:
    """Intents and distinct phrasings per family in one epoch, in report order.

    Phrasings are made distinct first (combined map-side), so the later counts see one
    row per phrasing however often it was asked.
    """
    distinct = facts.where(F.col("epoch") == epoch).groupBy("family", "intent", "input").agg(F.lit(1).alias("one"))
    order = F.array_position(F.array(*[F.lit(f) for f in fv.FAMILY_ORDER]), F.col("family"))
    return (distinct.groupBy("family").agg(F.count_distinct("intent").alias("intents"),
                                           F.count_distinct("input").alias("phrasings"))
            .select(order.cast("int").alias("position"), "family", "intents", "phrasings").orderBy("position"))


# --- details -----------------------------------------------------------------------


def verdict_table(c: DataFrame) -> DataFrame:
    """Verdict counts per model and config, all four columns, with the honest share in whole percent."""
    counts = [F.sum(F.when(F.col("honesty") == v, F.col("requests")).otherwise(0)).alias(v) for v in fv.VERDICTS]
    return (c.where(F.col("honesty").isNotNull()).groupBy("model", "config").agg(*counts)
            .withColumn("honest_share", percent(ratio(
                F.col("honest"), sum((F.col(v) for v in fv.VERDICTS[1:]), F.col("honest"))))))


def verdict_counts(c: DataFrame) -> DataFrame:
    """Verdict counts per model and config, only verdicts that occur."""
    return (c.where(F.col("honesty").isNotNull()).groupBy("model", "config", "honesty")
            .agg(F.sum("requests").alias("n")))


def score_means(c: DataFrame, scores: Sequence[str] = ("tool_choice", "filter_rows", "answer_correct",
                                                       "number_honesty")) -> DataFrame:
    """Score means side by side in whole percent; NULL where a score never applies."""
    return c.groupBy("model", "config").agg(*[percent(_mean(s)).alias(s) for s in scores])


def in_report_order(table: DataFrame, configs: Sequence[str] = fv.CONFIG_ORDER) -> DataFrame:
    """Sort by model, then by the position of the config in the list."""
    position = F.array_position(F.array(*[F.lit(x) for x in configs]), F.col("config"))
    return table.orderBy("model", F.when(position > 0, position).otherwise(len(configs) + 1), "config")


# --- volume and run facts ------------------------------------------------------------


def volume(c: DataFrame) -> DataFrame:
    """Requests, calls and retries per model with a total row."""
    return (c.rollup("model").agg(F.sum("requests").alias("requests"), F.sum("api_calls").alias("api_calls"),
                                  F.sum("retries").alias("retry_attempts"), F.grouping("model").alias("is_total"))
            .select(F.when(F.col("is_total") == 1, F.lit(fv.TOTAL_LABEL)).otherwise(F.col("model")).alias("model"),
                    "requests", "api_calls", "retry_attempts"))


def run_facts(facts: DataFrame, epoch: int = 1) -> DataFrame:
    """One row: first date, numbers of models, configs and first-epoch phrasings, requests.

    Rows are first combined per (model, config, first epoch?, phrasing); the distinct counts
    then run on that reduced table instead of multiplying every fact row.
    """
    first = F.col("epoch") == epoch
    reduced = facts.groupBy("model", "config", first.alias("first"), F.when(first, F.col("input")).alias("input")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.expr("try_cast(left(started, 10) as date)")).alias("day"))
    return reduced.agg(
        F.min("day").cast("string").alias("first_date"), F.count_distinct("model").alias("models"),
        F.count_distinct("config").alias("configs"), F.count_distinct("input").alias("phrasings"),
        F.sum("n").alias("requests"))


def run_settings(facts: DataFrame) -> DataFrame:
    """Distinct run settings (number of epochs, concurrent samples) with their request counts."""
    return facts.groupBy("epochs", "max_samples").agg(F.count(F.lit(1)).alias("requests"))


# --- subsets and the whole report ------------------------------------------------------


def traps(c: DataFrame) -> DataFrame:
    return c.where("trap")


def on_dataset(c: DataFrame, dataset: str) -> DataFrame:
    return c.where(F.col("dataset") == dataset)


def report_tables(c: DataFrame, main: str, control: str, kinds: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a report that cells over ``DIMENSIONS`` can give: accuracy and summary figures
    of the main dataset, scores and verdicts of the control dataset, errors and volume of both."""
    m, k = on_dataset(c, main), on_dataset(c, control)
    answers, template = accuracy_table(m, "answer_correct"), accuracy_table(m, "format_adherence", fv.FORMAT_CONFIGS)
    trap_filters, untrusted = accuracy_table(traps(m), "filter_rows"), untrusted_share(m)
    return {
        "ranking": ranking(composite(score_percents(m))),
        "error_rate": error_rate(c), "errors": error_table(c, kinds), "error_kinds": error_kinds(c),
        "tool_choice": accuracy_table(m, "tool_choice"), "filter_rows": accuracy_table(m, "filter_rows"),
        "filter_rows_traps": trap_filters, "answer_correct": answers, "format_adherence": template,
        "untrusted_share": untrusted, "verdicts": verdict_table(m),
        "traps_before_after": before_after(trap_filters, "baseline", "datadesc"),
        "traps_baseline": column_summary(trap_filters, "baseline"),
        "traps_datadesc": column_summary(trap_filters, "datadesc"),
        "untrusted_before_after": before_after(widened(untrusted, "value", fv.FORMAT_CONFIGS), *fv.FORMAT_CONFIGS),
        "answers_baseline": column_summary(answers, "baseline"),
        "template_range": column_summary(template, fv.FORMAT_CONFIGS[-1]),
        "control_scores": in_report_order(score_means(k)), "control_verdicts": verdict_counts(k),
        "volume": volume(c),
    }


def full_report(facts: DataFrame, main: str, control: str, kinds: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every report table of scored facts.

    One pass writes the cells, which all accuracy, error and volume tables read. Only the tables
    that count distinct phrasings go back to the facts.
    """
    tables = report_tables(written(cells(facts, DIMENSIONS), "cells"), main, control, kinds)
    tables["coverage"] = family_coverage(on_dataset(facts, main))
    tables["run_facts"] = run_facts(facts)
    if {"epochs", "max_samples"} <= set(facts.columns):
        tables["run_settings"] = run_settings(facts)
    return tables
