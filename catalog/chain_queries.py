"""The whole way from logged conversations over samples and generated statements to report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.extract_queries import conversations
from catalog.registry import query
from catalog.report_queries import KINDS, _PCT
from tablegauge import fixed_values as fv
from tablegauge.functions.tools import expected_tools
from tablegauge.operators.scoring import facts
from tablegauge.operators.statements import bind
from tablegauge.plans import evaluation, report
from tablegauge.workdir import written

# What extraction makes of the conversations that runs are logged as; a third of all requests were tried twice.
_EXTRACTED = v.RUNS.replace("runs as (", "logged as (", 1) + """,
runs as (
  select * replace (
    case when k % 5 = 4 then '' else reply || chr(10) || 'line two' end as text,
    split_part(error, ':', 1) || ': ' || left(repeat(error, 20), 300) as error,
    case when tool_case in (1, 2) then update_sql end as update_sql,
    case when run_id % 3 = 0 then 1 else 0 end as retries)
  from logged)"""
_FILTERED = """filtered as (
  select s.*, case when s.family = 'filter' then case when coalesce(c.n = s.truth_row, false) then 1.0 else 0.0 end end::double
      as filter_rows
  from scored s left join counts c on s.dataset = c.dataset and rtrim(s.update_sql, ';') = c.statement)"""
CHAIN = v.with_ctes(v.MANIFEST, _EXTRACTED, v.COUNTS, v.SCORED, _FILTERED)


def logged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with what identifies a request; a rate-limited first attempt stands before a third of them."""
    told = v.runs(spark, sf_dir).select("run_id", "model", "provider", "reasoning", "config", "epoch", "started")
    # Both attempts come from one row, so the conversations are made and joined once.
    attempts = F.when(F.col("run_id") % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    logged = conversations(spark, sf_dir).join(told, "run_id").withColumns({
        "sample_id": F.col("run_id").cast("string"), "attempt": F.explode(attempts)})
    early = (F.col("run_id") % 3 == 0) & (F.col("attempt") == 0)
    said = {"error_type": F.lit("RateLimitError"), "error_message": F.lit("try again in 5s"),
            "updates": F.array(F.lit("SELECT 0"))}
    return logged.withColumns({name: F.when(early, value).otherwise(F.col(name)) for name, value in said.items()})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request asked for, with its truth."""
    return v.runs(spark, sf_dir).select(
        F.col("run_id").cast("string").alias("id"), "input", F.lit("{}").alias("target"), F.struct(
            "dataset", "intent", "family", F.lit(0).alias("variant"), "trap", F.lit(False).alias("rate"),
            expected_tools(F.col("family")).alias("expected_tools"), F.array().cast("array<string>").alias("truth_sql"),
            F.array("truth_row").alias("truth_rows"), F.array("truth_rate").alias("truth_rates"),
            F.array(F.col("truth_row").cast("double"), F.col("truth_rate")).alias("truth_values")).alias("metadata"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"manifest": bind(v.manifest(spark, sf_dir), "manifest"), "labels": bind(v.read(spark, sf_dir, "labels"), "labels")}
    return evaluation.score_conversations(logged_conversations(spark, sf_dir), samples(spark, sf_dir), tables,
                                          suggestion_datasets=v.SUGGESTION_DATASETS)


@query("chain_scored_conversations", CHAIN + """
    select label as model, config, dataset, family, count(*) as n, count(*) filter (errored) as errors, sum(retries)::bigint as retries,
      sum(api_calls)::bigint as api_calls, """ + ", ".join(f"sum({s}) as {s}, count({s}) as n_{s}" for s in fv.SCORES) + """
    from filtered group by label, config, dataset, family""")
def scored_conversations(spark, sf_dir):
    """Kept attempts, extraction, samples, statement counts and all five scores."""
    sums = [part for s in fv.SCORES for part in (F.sum(s).alias(s), F.count(s).alias(f"n_{s}"))]
    return facts(scored(spark, sf_dir)).groupBy("model", "config", "dataset", "family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"), F.sum("retries").alias("retries"),
        F.sum("api_calls").alias("api_calls"), *sums)


def _accuracy(name: str, score: str) -> str:
    return (f"select '{name}' as report, label as model, config, {_PCT.format(s=score)} as value from filtered "
            f"where dataset = 'manifest' and {score} is not null group by label, config")


@query("chain_full_report", CHAIN + " union all ".join([
    _accuracy("tool_choice", "tool_choice"), _accuracy("filter_rows", "filter_rows"), _accuracy("answer_correct", "answer_correct"),
    "select 'requests', label, null, count(*) from filtered group by label",
    "select 'errors', label, null, count(*) filter (errored) from filtered group by label",
    f"select 'control', label, config, {_PCT.format(s='tool_choice')} from filtered where dataset = 'labels' group by label, config",
    "select 'models', null, null, count(distinct label) from filtered"]))
def full_report(spark, sf_dir):
    """Tables of one full report over the scored conversations, one below the other."""
    tables = report.full_report(written(facts(scored(spark, sf_dir)), "facts"), "manifest", "labels", KINDS)

    def long(name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("value")) for c in fv.CONFIG_ORDER])
        return tables[name].select(F.lit(name).alias("report"), "model", F.inline(cells)).where("value is not null")

    none = F.lit(None).cast("string")
    parts = [long("tool_choice"), long("filter_rows"), long("answer_correct"),
             tables["errors"].select(F.lit("requests").alias("report"), "model", none.alias("config"), F.col("requests").alias("value")),
             tables["errors"].select(F.lit("errors").alias("report"), "model", none.alias("config"), F.col("errors").alias("value")),
             tables["control_scores"].select(F.lit("control").alias("report"), "model", "config", F.col("tool_choice").alias("value")),
             tables["run_facts"].select(F.lit("models").alias("report"), none.alias("model"), none.alias("config"),
                                        F.col("models").alias("value"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
