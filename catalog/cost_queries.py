"""Queries for spend and the run matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tablegauge import fixed_values as fv
from tablegauge.functions import tools
from tablegauge.plans import cost, matrix

# Prices of the models that occur in the runs; usage is measured from the runs themselves.
PRICES = [fv.Price("m0", 0.80, 4.00, None), fv.Price("m1", 0.60, 3.00, None),
          fv.Price("m2", 0.075, 0.30, 0.0375), fv.Price("m3", 0.15, 0.60, 0.075)]
MODELS = [p.model for p in PRICES]

_PRICES = "prices as (select * from (values " + ", ".join(
    f"('{p.model}', {p.p_in}::double, {p.p_out}::double, {'null' if p.p_cached is None else p.p_cached}::double)"
    for p in PRICES) + ") p(model, p_in, p_out, p_cached))"
_USAGE = """usage as (
  select model, avg(1 + case tool_case when 0 then 2 when 1 then 1 when 2 then 2 else 0 end) as calls,
    cast(floor(avg(tokens_in) + 0.5) as bigint) as inp, cast(floor(avg(tokens_out) + 0.5) as bigint) as out,
    cast(floor(avg(k) + 0.5) as bigint) as cached
  from runs group by model)"""
USAGE = v.with_ctes(v.RUNS, _PRICES, _USAGE)
_USD = "(inp * {h}::double * p_in + out * p_out + cached * {h}::double * coalesce(p_cached, 0.0::double)) / 1e6"


def metered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.runs(spark, sf_dir).select("model", "retries", "tokens_in", "tokens_out",
                                        F.col("k").cast("bigint").alias("tokens_cached"),
                                        tools.api_calls(v.tool_names()).alias("api_calls"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.usage_profile(metered_runs(spark, sf_dir))


@query("K1_request_cost", USAGE + f"""
    select model, {_USD.format(h='1.0')} as usd, {_USD.format(h='1.3')} as usd_with_history from usage join prices using (model)""")
def request_cost(spark, sf_dir):
    prices = cost.price_table(spark, PRICES)
    usage = _usage(spark, sf_dir)
    plain = cost.request_cost(usage, prices)
    return plain.withColumn("usd_with_history", cost.tokens_cost(
        F.col("inp") * fv.HISTORY_FACTOR, F.col("out"), F.col("cached") * fv.HISTORY_FACTOR)).select(
        "model", "usd", "usd_with_history")


_MEASURED = """measured as (
  select model, count(*) as samples, sum(retries)::bigint as retries, sum(case when met then tokens_in else 0 end)::bigint as tokens_in,
    sum(case when met then tokens_out else 0 end)::bigint as tokens_out, sum(case when met then k else 0 end)::bigint as tokens_cached,
    count(*) filter (met) as measured_samples
  from (select *, model <> 'm2' and (tokens_in <> 0 or tokens_out <> 0) as met from runs) t group by model)"""


def _partly_metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model without any token counts, so that its spend is an estimate."""
    r = metered_runs(spark, sf_dir)
    return r.withColumns({c: F.when(F.col("model") != "m2", F.col(c)) for c in ("tokens_in", "tokens_out", "tokens_cached")})


@query("K2_measured_usage", v.with_ctes(v.RUNS, _MEASURED) + "select * from measured")
def measured_usage(spark, sf_dir):
    return cost.measured_usage(_partly_metered(spark, sf_dir))


_SPEND = f"""spends as (
  select m.model, samples, retries, measured_samples, case when measured_samples > 0
      then (tokens_in * p_in + tokens_out * p_out + tokens_cached * coalesce(p_cached, 0.0::double)) / 1e6
      else (samples + 0.5::double * retries) * ({_USD.format(h='1.0')}) end as usd
  from measured m left join prices p on m.model = p.model left join usage u on m.model = u.model)"""
SPEND = v.with_ctes(v.RUNS, _PRICES, _USAGE, _MEASURED, _SPEND)


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.spend(cost.measured_usage(_partly_metered(spark, sf_dir)), _usage(spark, sf_dir),
                      cost.price_table(spark, PRICES))


@query("K3_spend_per_model", SPEND + "select * from spends")
def spend(spark, sf_dir):
    return _spend(spark, sf_dir)


@query("K4_spend_with_total", SPEND + """
    select coalesce(model, '**total**') as model, sum(samples)::bigint as samples, sum(retries)::bigint as retries,
      round(sum(usd), 6) as usd from spends group by rollup (model)""")
def spend_with_total(spark, sf_dir):
    return cost.spend_with_total(_spend(spark, sf_dir)).withColumn("usd", F.round("usd", 6))


@query("K5_requests_per_dollar", USAGE + f"""
    select model, inp, out, cached, usd, 1.0::double / usd as per_dollar
    from (select model, inp, out, cached, {_USD.format(h='1.0')} as usd from usage join prices using (model)) t""")
def requests_per_dollar(spark, sf_dir):
    return cost.requests_per_dollar(cost.request_cost(_usage(spark, sf_dir), cost.price_table(spark, PRICES))).drop("calls")


_COHORT = USAGE + f""", costs as (select model, {_USD.format(h='1.3')} as usd from usage join prices using (model)),
scenarios as (select * from (values {', '.join(f"('{n}', {r})" for n, r in fv.SCENARIOS)}) s(scenario, requests))
"""


@query("K6_cohort_table", _COHORT + "select scenario, requests, " + ", ".join(
    f"max({fv.COHORT_SIZE} * requests * usd) filter (model = '{m}') as {m}" for m in MODELS)
    + " from costs, scenarios group by scenario, requests")
def cohort_table(spark, sf_dir):
    costs = cost.request_cost(_usage(spark, sf_dir), cost.price_table(spark, PRICES), fv.HISTORY_FACTOR)
    return cost.cohort_table(costs, MODELS)


@query("K7_rate_limits", USAGE + """
    select model, inp + out + cached as tokens, 200000 // (inp + out + cached) as free_requests_per_day,
      inp + out + cached <= 8000 as free_minute_ok, 250000 // (inp + out + cached) as paid_requests_per_minute from usage""")
def rate_limits(spark, sf_dir):
    return cost.rate_limits(_usage(spark, sf_dir))


@query("K8_burst_tokens", USAGE + f"select model, {fv.COHORT_SIZE} * (inp + out + cached) as tokens_per_minute from usage")
def burst_tokens(spark, sf_dir):
    return cost.burst_tokens(_usage(spark, sf_dir))


# --- run matrix --------------------------------------------------------------------------

CONFIGS = {"manifest": ["baseline", "datadesc", "format", "format_query"], "labels": ["baseline", "format", "format_query"]}
_CONFIGS = "configs as (select * from (values " + ", ".join(
    f"('{d}', '{c}')" for d, cs in CONFIGS.items() for c in cs) + ") c(dataset, config))"
_EXPECTED = f"""expected as (
  select s.dataset, s.sample, c.config, m.model, e.epoch
  from (select distinct dataset, input as sample from runs) s join configs c on s.dataset = c.dataset,
    (values {', '.join(f"('{m}')" for m in MODELS)}) m(model), (values (1), (2), (3)) e(epoch))"""
MATRIX = v.with_ctes(v.RUNS, _CONFIGS, _EXPECTED)


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = v.runs(spark, sf_dir).select("dataset", F.col("input").alias("id")).distinct()
    return matrix.expected_cells(asked, matrix.config_table(spark, CONFIGS), MODELS, 3)


@query("M1_expected_cells", MATRIX + """
    select dataset, config, model, count(*) as n, count(distinct sample) as samples from expected
    group by dataset, config, model""")
def expected_cells(spark, sf_dir):
    return _expected(spark, sf_dir).groupBy("dataset", "config", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sample").alias("samples"))


@query("M2_undefined_cells", MATRIX + """
    select distinct dataset, config from runs r
    where not exists (select 1 from configs c where c.dataset = r.dataset and c.config = r.config)""")
def undefined_cells(spark, sf_dir):
    return matrix.undefined_cells(v.runs(spark, sf_dir), matrix.config_table(spark, CONFIGS).drop("demands_format"))


@query("M3_missing_cells", MATRIX + """
    select e.dataset, e.sample, e.config, e.model, e.epoch from expected e
    where not exists (select 1 from runs r where r.dataset = e.dataset and r.input = e.sample
      and r.config = e.config and r.model = e.model and r.epoch = e.epoch)""")
def missing_cells(spark, sf_dir):
    observed = v.runs(spark, sf_dir).withColumnRenamed("input", "sample")
    return matrix.missing_cells(_expected(spark, sf_dir), observed, ["dataset", "sample", "config", "model", "epoch"])


@query("M4_epoch_spread", v.with_ctes(v.RUNS, v.SCORED) + """
    select model, config, sum(s) / sum(n) as accuracy, count(*) as epochs, min(s / n) as lowest_epoch, max(s / n) as highest_epoch
    from (select model, config, epoch, sum(tool_choice) as s, count(tool_choice) as n from scored group by 1, 2, 3) t
    where n > 0 group by model, config""")
def epoch_spread(spark, sf_dir):
    return matrix.epoch_spread(v.facts(spark, sf_dir), "tool_choice")


@query("M5_compare_reasoning", v.with_ctes(v.RUNS, v.SCORED) + """
    select model, config, reasoning, count(*) as requests, avg(tool_choice) as tool_choice,
      avg(number_honesty) as number_honesty, avg(tokens_out) as tokens_out
    from scored group by model, config, reasoning""")
def compare_reasoning(spark, sf_dir):
    return matrix.compare_settings(v.scored_runs(spark, sf_dir), "reasoning", ["model", "config"],
                                   ["tool_choice", "number_honesty", "tokens_out"])
