"""Queries for extraction from conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tablegauge import fixed_values as fv
from tablegauge.functions import errors
from tablegauge.operators import extract
from tablegauge.sources.schemas import TURNS

RUNS = v.with_ctes(v.RUNS)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as nested conversations: the request, a turn of tool calls, their results, the answer."""
    k, case = F.col("k"), F.col("tool_case")
    none = F.lit(None).cast("string")

    def content(kind: str, text=none, name=none, sql=none):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), name.alias("name"), sql.alias("query"))

    def call(name: str, sql=none):
        return content("tool", name=F.lit(name), sql=sql)

    def turn(role: str, tokens, *contents):
        held = F.array(*contents) if contents else F.array().cast(
            "array<struct<kind: string, text: string, name: string, query: string>>")
        return F.struct(F.lit(role).alias("role"), tokens.cast("array<bigint>").alias("tokens"), held.alias("contents"))

    asked = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("SELECT "), k.cast("string")))
    tokens = F.when(k % 3 == 0, F.array("tokens_in", "tokens_out")).otherwise(
        F.array("tokens_in", "tokens_out", k.cast("bigint")))
    think = content("reasoning", F.lit("hm"))
    tool_turn = (F.when(case == 0, turn("assistant", tokens, think, call(fv.SCHEMA_TOOL), call(fv.QUERY_TOOL, asked)))
                 .when(case == 1, turn("assistant", tokens, think, call(fv.UPDATE_TOOL, F.col("update_sql"))))
                 .when(case == 2, turn("assistant", tokens, call(fv.UPDATE_TOOL, F.col("update_sql")),
                                       call(fv.QUERY_TOOL, asked)))
                 .otherwise(turn("assistant", tokens, think)))
    answer = turn("assistant", F.when(k % 7 > 0, F.array(k.cast("bigint"), F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))),
                  content("text", F.concat(F.lit(" \n"), "reply")), content("reasoning", F.lit("zz")),
                  content("text", F.lit("line two \t")))
    start = F.array(turn("user", F.lit(None), content("text", F.col("input"))), tool_turn,
                    turn("user", F.array(F.lit(7), F.lit(7), F.lit(7))))
    return v.runs(spark, sf_dir).select(
        "run_id", F.when(k % 5 == 4, start).otherwise(F.concat(start, F.array(answer))).cast(TURNS.replace(": ", ":")).alias("turns"),
        F.when(case.isin(1, 2), F.array(F.lit("SELECT 1"), F.col("update_sql"))).otherwise(
            F.array().cast("array<string>")).alias("updates"),
        F.when(F.col("family") == "reset", F.array(F.lit(True))).alias("resets"),
        F.substring_index("error", ":", 1).alias("error_type"),
        F.when(F.col("error").isNotNull(), F.repeat(F.col("error"), F.lit(20))).alias("error_message"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.run_results(conversations(spark, sf_dir))


@query("X1_summed_tokens", RUNS + """
    select run_id, tokens_in + case when k % 5 <> 4 and k % 7 > 0 then k else 0 end as tokens_in,
      tokens_out + case when k % 5 <> 4 and k % 7 > 0 then 1 else 0 end as tokens_out,
      case when k % 3 = 0 then 0 else k end + case when k % 5 <> 4 and k % 7 > 0 then 2 else 0 end as tokens_cached
    from runs""")
def summed_tokens(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", "tokens_in", "tokens_out", "tokens_cached")


@query("X2_tool_names", RUNS + """
    select run_id, case tool_case when 0 then '<schema>,<query>'
      when 1 then '<update>' when 2 then '<update>,<query>'
      else '' end as tools from runs""")
def tool_names(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", F.array_join("tools", ",").alias("tools"))


@query("X3_query_statements", RUNS + """
    select run_id, case when tool_case in (0, 2) then 1 else 0 end as n,
      case when tool_case in (0, 2) and run_id % 2 = 0 then 'SELECT ' || cast(k as varchar) else '' end as statements
    from runs""")
def query_statements(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", F.size("query_sql").alias("n"),
                                            F.array_join("query_sql", ";").alias("statements"))


@query("X4_final_answer_nested", RUNS + """
    select run_id, case when k % 5 = 4 then '' else reply || chr(10) || 'line two' end as text from runs""")
def final_answer(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", "text")


@query("X4_last_answer_of_turn_table", r"""
    select conv_id, role as last_role, case when role = 'assistant' then
        md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) else md5('') end as answer
    from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) t
    where r = 1""")
def last_answer(spark, sf_dir):
    turns = v.read(spark, sf_dir, "conversations")
    return extract.last_answers(turns).select("conv_id", "last_role", F.md5("text").alias("answer"))


@query("X5_last_filter_and_reset", RUNS + """
    select run_id, case when tool_case in (1, 2) then update_sql end as update_sql, family = 'reset' as reset from runs""")
def last_filter(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", "update_sql", "reset")


@query("X6_error_text", RUNS + """
    select run_id, split_part(error, ':', 1) || ': ' || left(repeat(error, 20), 300) as error from runs""")
def error_text(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", "error")


@query("X7_completion", RUNS + """
    select run_id, case when k % 5 <> 4 then reply || chr(10) || 'line two'
      when error is not null then '[ERROR] ' || split_part(error, ':', 1) || ': ' || left(repeat(error, 20), 300)
      else '' end as completion from runs""")
def completion(spark, sf_dir):
    return _extracted(spark, sf_dir).select("run_id", errors.completion(F.col("text"), F.col("error")).alias("completion"))


_ATTEMPTS = """attempts as (
  select cast(floor(run_id / 4) as bigint) as request, cast(run_id % 4 as int) as attempt, k,
    case k % 4 when 0 then null
      when 1 then 'RateLimitError: please try again in ' || cast(k * 10 as varchar) || 'ms.'
      when 2 then 'RateLimitError: try again in ' || cast(k as varchar) || '.5s'
      else case when k % 3 = 0 then 'APIError: Failed to parse tool call' else 'RateLimitError: slow down' end end as error
  from runs)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs read as up to four attempts per request."""
    k = F.col("k")
    text = (F.when(k % 4 == 0, F.lit(None).cast("string"))
            .when(k % 4 == 1, F.concat(F.lit("RateLimitError: please try again in "), (k * 10).cast("string"), F.lit("ms.")))
            .when(k % 4 == 2, F.concat(F.lit("RateLimitError: try again in "), k.cast("string"), F.lit(".5s")))
            .when(k % 3 == 0, F.lit("APIError: Failed to parse tool call")).otherwise(F.lit("RateLimitError: slow down")))
    return v.runs(spark, sf_dir).select(
        F.floor(F.col("run_id") / 4).alias("request"), (F.col("run_id") % 4).cast("int").alias("attempt"), "k",
        text.alias("error"))


@query("X8_retry_wait", v.with_ctes(v.RUNS, _ATTEMPTS) + """
    select request, attempt, least(case k % 4 when 1 then k * 10 / 1000.0::double when 2 then k + 0.5::double else 2.0 end::double,
      20.0::double) + 1.0 + attempt as wait
    from attempts where contains(error, 'RateLimitError')""")
def retry_wait(spark, sf_dir):
    return attempts(spark, sf_dir).where(errors.is_rate_limited(F.col("error"))).select(
        "request", "attempt", errors.retry_wait(F.col("error"), F.col("attempt")).alias("wait"))


@query("X9_kept_attempt", v.with_ctes(v.RUNS, _ATTEMPTS) + """
    select request, attempt as retries, k, error from (
      select *, row_number() over (partition by request order by
        coalesce(contains(error, 'RateLimitError'), false),
        case when contains(error, 'RateLimitError') then -attempt else attempt end) as r
      from attempts) t where r = 1""")
def kept_attempt(spark, sf_dir):
    return extract.kept_attempts(attempts(spark, sf_dir), ["request"]).select(
        "request", "retries", "k", "error")


@query("X_results_of_call_table", RUNS + """
    select user, max(case when tool_case in (1, 2) then 1 else 0 end) = 1 as updated,
      max(case when tool_case in (0, 2) then 1 else 0 end) = 1 as queried,
      count(*) filter (tool_case in (0, 1, 2)) as n_tools,
      arg_max(update_sql, run_id) filter (tool_case in (1, 2) and update_sql is not null) as update_sql
    from (select *, run_id % 20 as user from runs) t where tool_case < 3 group by user""")
def results_of_call_table(spark, sf_dir):
    c = F.col("tool_case")
    name = F.when(c == 0, fv.QUERY_TOOL).when(c == 1, fv.UPDATE_TOOL).otherwise(fv.UPDATE_TOOL)
    calls = v.runs(spark, sf_dir).where(c < 3).select(
        (F.col("run_id") % 20).alias("user"), F.col("run_id").alias("position"), name.alias("name"),
        F.col("update_sql").alias("statement"), c)
    extra = calls.where(c == 2).withColumn("name", F.lit(fv.QUERY_TOOL)).withColumn("statement", F.lit(None).cast("string"))
    merged = extract.tool_call_results(calls.unionByName(extra), "user")
    twice = calls.where(c == 2).groupBy("user").agg(F.count(F.lit(1)).alias("twice"))
    return merged.join(twice, "user", "left").select(
        "user", F.array_contains("tools", fv.UPDATE_TOOL).alias("updated"),
        F.array_contains("tools", fv.QUERY_TOOL).alias("queried"),
        (F.col("n_tools") - F.coalesce("twice", F.lit(0))).alias("n_tools"), "update_sql")
