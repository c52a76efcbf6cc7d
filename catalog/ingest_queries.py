"""Queries over stores that run logs are added to: samples, cells and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.dashboard_queries import logged_samples
from catalog.registry import query
from tablegauge.plans import report
from tablegauge.sources import ingest, runlogs
from tablegauge.workdir import new_path

_HEADER = ["status", "created", "epochs", "max_samples", "metadata"]

# Logs of one cell of the run matrix, day and status; every third day is logged later.
_LOGS = """logs as (
  select *, case when run_id % 100 < 50 then 'success' else 'error' end as status,
    date_diff('day', date '2000-01-01', cast(left(started, 10) as date)) % 3 = 0 as later,
    case provider when '<home>' then model else model || ' @' || provider end as label
  from runs)"""
_CURRENT = """newest as (
  select * from (select *, max(started) over (partition by full_model, provider, config, dataset, reasoning) as newest
                 from logs where status = 'success') t where started = newest)"""


def logs_of_several_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as a harness writes them: several samples each, failed ones among them, and ones that ended before any sample."""
    full = logged_samples(spark, sf_dir).groupBy(*_HEADER).agg(F.collect_list("sample").alias("samples"))
    none = full.select(F.lit("started").alias("status"), *_HEADER[1:], F.slice("samples", 1, 0).alias("samples"))
    day = F.datediff(F.left("created", F.lit(10)).cast("date"), F.lit("2000-01-01").cast("date"))
    return full.unionByName(none).withColumn("later", day % 3 == 0)


def store(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    """A store that logs were added to twice, and the numbers of logs that were read."""
    logs, path, read = new_path(spark, "logs"), new_path(spark, "store"), []
    written = logs_of_several_samples(spark, sf_dir)
    for later in (False, True):
        written.where(F.col("later") == later).drop("later").write.mode("append").json(logs)
        read.append(ingest.ingest(spark, logs, path))
    return path, read


@query("S7_incremental_logs", v.with_ctes(v.RUNS, _LOGS) + """
    select label as model, config, count(*) as n, sum(case when k % 3 = 0 then 1 when k % 3 = 1 then 0 end)::double as correct,
      count(case when k % 3 <> 2 then 1 end) as scored, sum(retries) as retries, count(error) as errors
    from logs where status = 'success' group by 1, 2""")
def incremental_logs(spark, sf_dir):
    samples = ingest.stored_samples(spark, store(spark, sf_dir)[0])
    rows = runlogs.facts_from_logs(runlogs.successful(samples))
    return rows.groupBy("model", "config").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tool_choice").alias("correct"), F.count("tool_choice").alias("scored"),
        F.sum("retries").alias("retries"), F.count_if("error").alias("errors"))


@query("S8_logs_read_once", v.with_ctes(v.RUNS, _LOGS) + """,
    held as (select distinct full_model, provider, config, dataset, reasoning, started, status, later from logs)
    select later, 2 * count(*) as logs from held group by later""")
def logs_read_once(spark, sf_dir):
    _, (first, second) = store(spark, sf_dir)
    return spark.range(2).select((F.col("id") == 1).alias("later"),
                                 F.when(F.col("id") == 1, second).otherwise(first).cast("long").alias("logs"))


@query("R5_kept_cells", v.with_ctes(v.RUNS, _LOGS, _CURRENT) + """
    select label as model, config, dataset, count(*) as requests, count(error) as errors, sum(retries)::bigint as retries,
      sum(case when k % 3 = 0 then 1 when k % 3 = 1 then 0 end)::double as right_tools, count(case when k % 3 <> 2 then 1 end) as scored
    from newest group by label, config, dataset""")
def kept_cells(spark, sf_dir):
    """Report cells of the newest runs, merged from what both additions left."""
    cells = ingest.kept_cells(spark, store(spark, sf_dir)[0], ["model", "config", "dataset"])
    return cells.select("model", "config", "dataset", "requests", "errors", "retries", F.col("sum_tool_choice").alias("right_tools"),
                        F.col("n_tool_choice").alias("scored"))


@query("R19_R26_distinct_from_sketches", v.with_ctes(v.RUNS, _LOGS, _CURRENT) + """
    select family, true as intents_close, true as phrasings_close, (select count(distinct label) from newest) as models,
      (select left(min(started), 10) from newest) as first_date, (select count(*) from newest) as requests
    from newest where epoch = 1 group by family""")
def distinct_from_sketches(spark, sf_dir):
    """Coverage estimated from kept cells, within five standard errors of the exact one over all stored facts."""
    path, _ = store(spark, sf_dir)
    kept = ingest.kept_cells(spark, path, [*report.DIMENSIONS, "first_epoch", "started"])
    facts = runlogs.facts_from_logs(runlogs.latest_runs(runlogs.successful(ingest.stored_samples(spark, path))))
    exact = report.family_coverage(facts).select("family", F.col("intents").alias("i"), F.col("phrasings").alias("p"))

    def close(estimate: str, true: str):
        return F.abs(F.col(estimate) - F.col(true)) <= F.greatest(F.lit(1.0), 5 * 0.016 * F.col(true))

    told = ingest.family_coverage(kept).join(exact, "family").select(
        "family", close("intents", "i").alias("intents_close"), close("phrasings", "p").alias("phrasings_close"), F.lit(1).alias("one"))
    facts_of_run = ingest.run_facts(kept).select("models", "first_date", "requests", F.lit(1).alias("one"))
    return told.join(F.broadcast(facts_of_run), "one").drop("one")  # one row
