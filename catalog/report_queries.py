"""Queries for report tables over scored facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tablegauge import fixed_values as fv
from tablegauge.functions import errors, tools
from tablegauge.plans import report
from tablegauge.sources.runlogs import model_label
from tablegauge.workdir import written

RUNS = v.with_ctes(v.RUNS)
SCORED = v.with_ctes(v.RUNS, v.SCORED)
KINDS = ["malformed tool call", "rate limit (retries exhausted)", "schema: `collapsed` missing", "TimeoutError"]
SCORES = ["tool_choice", "answer_correct", "number_honesty"]

# Whole percent of the mean score per model and config.
_PCT = "cast(round_even(avg({s}) * 100, 0) as bigint)"
_LONG = "select model, config, " + _PCT + " as value, count({s}) as n from scored where {s} is not null {w} group by model, config"


def _wide(score: str, configs: list[str], where: str = "") -> str:
    columns = ", ".join(f"max(value) filter (config = '{c}') as {c}" for c in configs)
    return f"select model, {columns} from ({_LONG.format(s=score, w=where)}) t group by model"


def cells(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return report.cells(v.facts(spark, sf_dir), list(keys))


@query("R1_error_kind", SCORED + "select run_id, error_kind from scored")
def error_kind(spark, sf_dir):
    return v.runs(spark, sf_dir).select("run_id", errors.error_kind(F.col("error")).alias("error_kind"))


@query("R2_model_label", RUNS + """
    select label, count(*) as n from (
      select case full_model when 'vendor/m3' then 'm3' else split_part(full_model, '/', 2) end
        || case provider when '<home>' then '' else ' @' || provider end as label from runs) t group by label""")
def labels(spark, sf_dir):
    return (v.runs(spark, sf_dir).select(model_label(F.col("full_model"), F.col("provider")).alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("R3_api_calls", SCORED + "select model, sum(api_calls)::bigint as api_calls from scored group by model")
def api_calls(spark, sf_dir):
    return (v.scorable_runs(spark, sf_dir).groupBy("model")
            .agg(F.sum(tools.api_calls(F.col("tools"))).alias("api_calls")))


@query("R4_fact_rows", SCORED + """
    select model, config, dataset, family, trap, intent, input, epoch, errored as error, error_kind, api_calls, retries,
      honesty, tool_choice, answer_correct, format_adherence, number_honesty from scored""")
def fact_rows(spark, sf_dir):
    return v.facts(spark, sf_dir).drop("reasoning", "started", "filter_rows")


@query("R5_accuracy_table", SCORED + _wide("tool_choice", fv.CONFIG_ORDER))
def accuracy_table(spark, sf_dir):
    return report.accuracy_table(cells(spark, sf_dir, "model", "config"), "tool_choice")


@query("R5_accuracy_long", SCORED + _LONG.format(s="number_honesty", w=""))
def accuracy_long(spark, sf_dir):
    return report.accuracy_long(cells(spark, sf_dir, "model", "config"), "number_honesty")


@query("R6_requests_per_config", SCORED + f"""
    select config, max(n) as n from ({_LONG.format(s='answer_correct', w='')}) t group by config""")
def requests_per_config(spark, sf_dir):
    return report.requests_per_config(cells(spark, sf_dir, "model", "config"), "answer_correct")


@query("R7_present_configs", SCORED + f"""
    select config, case config when 'format' then 3 else 4 end as position, max(n) as n
    from ({_LONG.format(s='format_adherence', w='')}) t group by config""")
def present_configs(spark, sf_dir):
    return report.present_configs(cells(spark, sf_dir, "model", "config"), "format_adherence")


@query("R8_best_of_column", SCORED + f"""
    select model, baseline as value from ({_wide('tool_choice', fv.CONFIG_ORDER)}) t
    order by baseline desc, model limit 1""")
def best(spark, sf_dir):
    return report.best(report.accuracy_table(cells(spark, sf_dir, "model", "config"), "tool_choice"), "baseline")


@query("R9_error_rate", SCORED + """
    select model, cast(round_even(avg(cast(errored as int)) * 100, 0) as bigint) as error_pct from scored group by model""")
def error_rate(spark, sf_dir):
    return report.error_rate(cells(spark, sf_dir, "model"))


@query("R10_untrusted_share", SCORED + """
    select model, config, avg(cast(honesty in ('wrong', 'unverified') as int)) * 100 as value
    from scored where honesty is not null group by model, config""")
def untrusted_share(spark, sf_dir):
    return report.untrusted_share(cells(spark, sf_dir, "model", "config", "honesty"))


# Three scores that exist in several configs, so that completeness and composites are not trivial.
# One model lacks one config: it must drop out wherever complete models are asked for.
_GAP = "not (model = 'm3' and config = 'format')"
_PERCENTS = "percents as (" + " union all ".join(
    f"select model, config, '{s}' as score, {_PCT.format(s=s)} as value from scored where {s} is not null "
    f"and {_GAP} group by model, config" for s in SCORES) + ")"
_COMPLETE = """complete as (select model from percents group by model
  having count(*) = (select count(*) from (select distinct score, config from percents) x))"""
_COMPOSITE = """composites as (select model, avg(mean) as composite from (
    select model, score, avg(value) as mean from percents group by model, score) t
  where model in (select model from complete) group by model)"""
REPORT_SQL = v.with_ctes(v.RUNS, v.SCORED, _PERCENTS, _COMPLETE, _COMPOSITE)


def _percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_percents(cells(spark, sf_dir, "model", "config").where(_GAP), SCORES)


@query("R11_complete_models", REPORT_SQL + "select model from complete")
def complete_models(spark, sf_dir):
    return report.complete_models(_percents(spark, sf_dir))


@query("R12_composite", REPORT_SQL + "select model, composite from composites")
def composite(spark, sf_dir):
    return report.composite(_percents(spark, sf_dir))


@query("R13_ranking", REPORT_SQL + """
    select model, composite, rank() over (order by composite desc) as rank,
      cast(round_even(composite, 0) as bigint) as composite_pct from composites""")
def ranking(spark, sf_dir):
    return report.ranking(report.composite(_percents(spark, sf_dir)))


@query("R14_aligned_tables", SCORED + f"""
    select model, a.format as tools_format, b.format as honest_format
    from ({_wide('tool_choice', ['format'])}) a full join ({_wide('number_honesty', ['format'])}) b using (model)""")
def aligned(spark, sf_dir):
    c = written(cells(spark, sf_dir, "model", "config"), "cells")
    return report.aligned({"tools": report.accuracy_table(c, "tool_choice", ["format"]),
                           "honest": report.accuracy_table(c, "number_honesty", ["format"])})


@query("R15_column_summary", SCORED + f"""
    select cast(trunc(avg(format_query)) as int) as mean_value, cast(min(format_query) as int) as min_value,
      cast(max(format_query) as int) as max_value from ({_wide('format_adherence', fv.FORMAT_CONFIGS)}) t""")
def column_summary(spark, sf_dir):
    table = report.accuracy_table(cells(spark, sf_dir, "model", "config"), "format_adherence", fv.FORMAT_CONFIGS)
    return report.column_summary(table, "format_query")


@query("R16_before_after", SCORED + f"""
    select model, baseline as before, format_query as after from ({_wide('answer_correct', fv.CONFIG_ORDER, 'and ' + _GAP)}) t
    where baseline is not null and datadesc is not null and format is not null and format_query is not null""")
def before_after(spark, sf_dir):
    table = report.accuracy_table(cells(spark, sf_dir, "model", "config").where(_GAP), "answer_correct")
    return report.before_after(table, "baseline", "format_query")


_VOLUME = """select model, count(*) as requests, sum(cast(errored as int))::bigint as errors,
    cast(round_even(sum(cast(errored as int)) / count(*) * 100 * 10, 0) / 10 as varchar) || '%' as error_rate"""


@query("R17_error_volume", SCORED + _VOLUME + " from scored group by model")
def error_volume(spark, sf_dir):
    return report.error_volume(cells(spark, sf_dir, "model"))


@query("R18_error_table", SCORED + _VOLUME + "".join(
    f", count(*) filter (error_kind = '{k}') as \"{k}\"" for k in KINDS)
    + ", count(*) filter (error_kind not in (" + ", ".join(f"'{k}'" for k in KINDS) + ")) as other from scored group by model")
def error_table(spark, sf_dir):
    return report.error_table(cells(spark, sf_dir, "model", "error_kind"), KINDS)


@query("R18_error_table_of_found_kinds", SCORED + _VOLUME + "".join(
    f", count(*) filter (error_kind = '{k}') as \"{k}\"" for k in KINDS) + " from scored group by model")
def error_table_of_found_kinds(spark, sf_dir):
    return report.error_table(written(cells(spark, sf_dir, "model", "error_kind"), "cells"))


@query("R18_error_kinds_long", SCORED + """
    select model, error_kind, count(*) as n from scored where error_kind is not null group by model, error_kind""")
def error_kinds(spark, sf_dir):
    return report.error_kinds(cells(spark, sf_dir, "model", "error_kind"))


@query("R19_family_coverage", RUNS + """
    select case family when 'filter' then 1 when 'question' then 2 else 3 end as position, family,
      count(distinct intent) as intents, count(distinct input) as phrasings
    from runs where epoch = 1 group by family""")
def family_coverage(spark, sf_dir):
    return report.family_coverage(v.facts(spark, sf_dir))


_VERDICTS = ", ".join(f"count(*) filter (honesty = '{x}') as {x}" for x in fv.VERDICTS)


@query("R20_R21_verdict_table", SCORED + f"""
    select model, config, {_VERDICTS},
      cast(round_even(count(*) filter (honesty = 'honest') / count(*) * 100, 0) as bigint) as honest_share
    from scored where honesty is not null group by model, config""")
def verdict_table(spark, sf_dir):
    return report.verdict_table(cells(spark, sf_dir, "model", "config", "honesty"))


_MEANS = ", ".join(f"{_PCT.format(s=s)} as {s}" for s in ("tool_choice", "answer_correct", "number_honesty"))


@query("R22_R23_score_means_in_order", SCORED + f"""
    select model, config, {_MEANS} from scored where dataset = 'labels' group by model, config""")
def score_means(spark, sf_dir):
    c = report.on_dataset(cells(spark, sf_dir, "dataset", "model", "config"), "labels")
    return report.in_report_order(report.score_means(c, ("tool_choice", "answer_correct", "number_honesty")))


@query("R24_verdict_counts", SCORED + """
    select model, config, honesty, count(*) as n from scored where honesty is not null and dataset = 'labels'
    group by model, config, honesty""")
def verdict_counts(spark, sf_dir):
    return report.verdict_counts(report.on_dataset(cells(spark, sf_dir, "dataset", "model", "config", "honesty"), "labels"))


@query("R25_volume_with_total", SCORED + """
    select coalesce(model, '**total**') as model, count(*) as requests, sum(api_calls)::bigint as api_calls,
      sum(retries)::bigint as retry_attempts from scored group by rollup (model)""")
def volume(spark, sf_dir):
    return report.volume(cells(spark, sf_dir, "model"))


@query("R26_run_facts", RUNS + """
    select left(min(started), 10) as first_date, count(distinct model) as models, count(distinct config) as configs,
      count(distinct input) filter (epoch = 1) as phrasings, count(*) as requests from runs""")
def run_facts(spark, sf_dir):
    return report.run_facts(v.facts(spark, sf_dir))


@query("R26_run_settings", RUNS + """
    select epoch as epochs, retries as max_samples, count(*) as requests from runs group by epoch, retries""")
def run_settings(spark, sf_dir):
    return report.run_settings(v.runs(spark, sf_dir).select(
        F.col("epoch").alias("epochs"), F.col("retries").alias("max_samples")))


@query("R27_traps_only", SCORED + _wide("tool_choice", fv.CONFIG_ORDER, "and trap"))
def traps_only(spark, sf_dir):
    return report.accuracy_table(report.traps(cells(spark, sf_dir, "model", "config", "trap")), "tool_choice")


@query("R28_one_dataset", SCORED + _wide("answer_correct", fv.CONFIG_ORDER, "and dataset = 'manifest'"))
def one_dataset(spark, sf_dir):
    c = report.on_dataset(cells(spark, sf_dir, "dataset", "model", "config"), "manifest")
    return report.accuracy_table(c, "answer_correct")


# --- scores with the row counts of the generated filters -------------------------------------------

_ACCEPTED = "coalesce(c.n between 200 and 402 and c.n % 10 = s.k % 3 and c.n <= 400 + s.k % 3, false)"
_FILTERED = f"""filtered as (
  select s.*, case when s.family = 'filter' then case
      when case when s.config in ('format', 'format_query') then coalesce(c.n = s.truth_row, false) else {_ACCEPTED} end
      then 1.0 else 0.0 end end::double as filter_rows
  from scored s left join counts c on s.dataset = c.dataset and rtrim(s.update_sql, ';') = c.statement)"""
FILTERED = v.with_ctes(v.MANIFEST, v.RUNS, v.COUNTS, v.SCORED, _FILTERED)
_PUBLISHED = "percents as (" + " union all ".join(
    f"select model, config, '{s}' as score, {_PCT.format(s=s)} as value from filtered where {s} is not null "
    f"and {_GAP} group by model, config" for s in report.COMPOSITE_SCORES) + ")"
PUBLISHED_SQL = v.with_ctes(v.MANIFEST, v.RUNS, v.COUNTS, v.SCORED, _FILTERED, _PUBLISHED, _COMPLETE, _COMPOSITE)


def filtered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored runs with every score; outside the format configs any multiple of ten near the German texts is accepted."""
    from catalog.score_queries import statement_counts
    from tablegauge.operators.scoring import score_runs
    from tablegauge.operators.statements import with_statement_counts

    near = F.transform(F.sequence(F.lit(20), F.lit(40)), lambda x: (x * 10 + F.col("k") % 3).cast("bigint"))
    runs = v.scorable_runs(spark, sf_dir).withColumn("truth_rows", F.when(
        (F.col("family") == "filter") & ~F.col("config").isin(fv.FORMAT_CONFIGS), near).otherwise(F.col("truth_rows")))
    counted = with_statement_counts(runs, statement_counts(spark, sf_dir), "dataset", "update_sql", spread_by=["run_id"])
    return score_runs(counted, "statement_rows", v.SUGGESTION_DATASETS)


def filtered_cells(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    from tablegauge.operators.scoring import facts

    return report.cells(facts(filtered_runs(spark, sf_dir).withColumn("provider", F.lit(None).cast("string"))), list(keys))


@query("R4_fact_rows_with_filters", FILTERED + """
    select model, config, dataset, family, trap, intent, input, epoch, errored as error, error_kind, api_calls, retries,
      honesty, tool_choice, filter_rows, answer_correct, format_adherence, number_honesty from filtered""")
def fact_rows_with_filters(spark, sf_dir):
    from tablegauge.operators.scoring import facts

    return facts(filtered_runs(spark, sf_dir).withColumn("provider", F.lit(None).cast("string"))).drop("reasoning", "started")


@query("R12_composite_of_published_scores", PUBLISHED_SQL + "select model, composite from composites")
def published_composite(spark, sf_dir):
    return report.composite(report.score_percents(filtered_cells(spark, sf_dir, "model", "config").where(_GAP)))


@query("R13_ranking_of_published_scores", PUBLISHED_SQL + """
    select model, composite, rank() over (order by composite desc) as rank,
      cast(round_even(composite, 0) as bigint) as composite_pct from composites""")
def published_ranking(spark, sf_dir):
    return report.ranking(report.composite(report.score_percents(filtered_cells(spark, sf_dir, "model", "config").where(_GAP))))


@query("R22_means_of_published_scores", FILTERED + "select model, config, " + ", ".join(
    f"{_PCT.format(s=s)} as {s}" for s in ("tool_choice", "filter_rows", "answer_correct", "number_honesty"))
    + " from filtered where dataset = 'labels' group by model, config")
def published_means(spark, sf_dir):
    return report.score_means(report.on_dataset(filtered_cells(spark, sf_dir, "dataset", "model", "config"), "labels"))


@query("R27_trap_filter_rows", FILTERED + _wide("filter_rows", fv.CONFIG_ORDER, "and trap").replace("from scored", "from filtered"))
def trap_filter_rows(spark, sf_dir):
    return report.accuracy_table(report.traps(filtered_cells(spark, sf_dir, "model", "config", "trap")), "filter_rows")


@query("C16_accuracy_of_all_scores", FILTERED + "select " + ", ".join(f"avg({s}) as {s}" for s in fv.SCORES) + " from filtered")
def accuracy_of_all_scores(spark, sf_dir):
    from tablegauge.operators import scoring

    return filtered_runs(spark, sf_dir).agg(*[scoring.accuracy(s).alias(s) for s in fv.SCORES])
