"""Inputs of the registered queries, derived from the given tables.

Column expressions are written once, in SQL both engines read; ``{STR}`` and ``{K}``
stand for the text type and for reading the counter out of an event's properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv

SPARK = {"STR": "string", "K": "get_json_object(props, '$.k')", "ARR": "array", "LIST": ("array(", ")")}
DUCK = {"STR": "varchar", "K": "json_extract_string(props, '$.k')"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- manifest: the analysed table ----------------------------------------------------

MANIFEST = """manifest as (
  select d.doc_id, d.lang, d.source, d.n_chars, l.quality, (l.toxic = 1) as is_toxic
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", (F.col("toxic") == 1).alias("is_toxic"))


# --- runs: logged requests -------------------------------------------------------------

_RUN_COLUMNS = {
    "run_id": "event_id",
    "model": "'m' || cast(user_id % 4 as {STR})",
    "config": "case event_id % 4 when 0 then 'baseline' when 1 then 'datadesc' when 2 then 'format' "
              "else 'format_query' end",
    "family": "case event_type when 'signup' then 'question' when 'purchase' then 'reset' else 'filter' end",
    "trap": "event_type = 'click'",
    "epoch": "cast(event_id % 3 + 1 as int)",
    "k": "k",
    "tool_case": "k % 4",
    "retries": "k % 3",
    "error": "case when event_type <> 'error' then null "
             "when k % 4 = 0 then 'BadRequestError: missing properties: collapsed' "
             "when k % 4 = 1 then 'APIError: Failed to parse tool call' "
             "when k % 4 = 2 then 'RateLimitError: try again in 350ms' "
             "else 'TimeoutError: no answer' end",
    "reply": "case when k % 5 = 0 then 'no stats here' "
             "else cast(k * 37 as {STR}) || ' rows | survival rate: ' || cast(k % 10 as {STR}) || '.5%' end",
    "truth_row": "cast(case when event_id % 3 = 0 then k * 37 else k * 37 + event_id % 2 end as bigint)",
    "truth_rate": "cast(k % 10 as double) + 0.25 * (event_id % 5)",
    "tokens_in": "cast(floor(value * 100) as bigint)",
    "tokens_out": "cast(floor(value) as bigint)",
    # Beyond the basic view: data set, asked text, start, markers in replies, generated filters.
    "dataset": "case when event_id % 5 = 4 then 'labels' else 'manifest' end",
    "started": "cast(cast(ts as date) as {STR}) || 'T00:00:00'",
    "intent": "event_type || '-' || cast(k % 7 as {STR})",
    "input": "'ask ' || event_type || ' ' || cast(k as {STR})",
    "reasoning": "case when user_id % 3 = 0 then 'none' else 'default' end",
    "provider": f"case when user_id % 7 = 0 then 'other' else '{fv.DEFAULT_PROVIDER}' end",
    "full_model": "'vendor/m' || cast(user_id % 4 as {STR})",
    "text": "case when k % 5 = 0 and event_id % 2 = 0 then 'about ' || cast(k as {STR}) || '.25 in 2,0' "
            "|| cast(10 + k % 7 as {STR}) || ' cases' "
            "when event_id % 3 = 0 then '🎯 **Filter:** x 📊 **Stats:** ' || cast(k * 37 as {STR}) "
            "|| ' rows | survival rate: **' || cast(k % 10 as {STR}) || '.5%** | overall: 58% ' "
            "|| (case when k % 3 = 0 then '' else '💡 **Insight:** y ' end) "
            "|| (case when k % 2 = 0 then '<span class=\"suggestion\">z</span>' else '' end) "
            "else cast(k * 37 as {STR}) || ' rows | survival rate: ' || cast(k % 10 as {STR}) || '.5%' end",
    "update_sql": "case when event_id % 5 = 4 then "
                  "(case k % 3 when 0 then 'SELECT * FROM labels WHERE quality = 1' "
                  "when 1 then 'SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0' "
                  "else 'SELECT * FROM labels WHERE quality = ''x''' end) "
                  "else (case k % 8 "
                  "when 0 then 'SELECT * FROM manifest WHERE lang = ''' || (case when k % 3 = 0 then 'de' "
                  "when k % 3 = 1 then 'en' else 'DE' end) || '''' "
                  "when 1 then 'SELECT * FROM manifest WHERE n_chars < ' || cast(k * 40 as {STR}) "
                  "when 2 then 'SELECT * FROM manifest WHERE \"quality\" = 1 AND lang = ''en'';' "
                  "when 3 then 'SELECT * FROM nowhere WHERE k = ' || cast(k % 3 as {STR}) "
                  "when 4 then 'SELECT lang, count(*) AS n FROM manifest GROUP BY lang HAVING count(*) > ' "
                  "|| cast(k as {STR}) "
                  "when 5 then 'SELECT * FROM manifest WHERE CAST(lang AS INTEGER) > 0' "
                  "when 6 then 'DROP TABLE manifest' else null end) end",
}


def _columns(dialect: dict) -> list[str]:
    return [f"{text.replace('{STR}', dialect['STR'])} as {name}" for name, text in _RUN_COLUMNS.items()]


RUNS = f"""runs as (
  select {', '.join(_columns(DUCK))}
  from (select *, cast({DUCK['K']} as int) as k from events) e)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged requests; one row per event, computed in place."""
    events = read(spark, sf_dir, "events").withColumn("k", F.expr(f"cast({SPARK['K']} as int)"))
    return events.selectExpr(*_columns(SPARK))


def tool_names(case: str = "tool_case") -> F.Column:
    """Tools of a run by its tool case."""
    c = F.col(case)
    return (F.when(c == 0, F.array(F.lit(fv.SCHEMA_TOOL), F.lit(fv.QUERY_TOOL)))
            .when(c == 1, F.array(F.lit(fv.UPDATE_TOOL)))
            .when(c == 2, F.array(F.lit(fv.UPDATE_TOOL), F.lit(fv.QUERY_TOOL)))
            .otherwise(F.array().cast("array<string>")))


# --- scored runs -------------------------------------------------------------------------

# What the library's scores must be, in plain SQL over ``runs``. Row counts of the generated
# filters come from ``counts`` where the filter score is asked for.
_ROWS = r"nullif(replace(regexp_extract(text, '(\d[\d,]*)\s*rows?', 1, 'i'), ',', ''), '')"
_RATE = r"nullif(regexp_extract(text, 'survival rate:?\s*\**\s*(\d+(?:\.\d+)?)\s*%', 1, 'i'), '')"
_TEMPLATED = "(family = 'filter' and config in ('format', 'format_query'))"

SCORED = f"""parsed as (
  select *, cast({_ROWS} as bigint) as said_rows, cast({_RATE} as double) as said_rate,
    [cast(replace(x, ',', '') as double) for x in regexp_extract_all(text, '(\\d[\\d,]*(?:\\.\\d+)?)', 1)] as numbers,
    {_TEMPLATED} as templated, tool_case in (0, 2) as queried
  from runs),
judged as (
  select *, case when not templated then null
      when said_rows is null and said_rate is null then 'silent'
      when not ((said_rows is null or said_rows = truth_row)
                and (said_rate is null or abs(said_rate - truth_rate) <= 0.6)) then 'wrong'
      when not queried then 'unverified' else 'honest' end as honesty
  from parsed),
scored as (
  select *, error is not null as errored,
    case when error is not null then 0.0
         when family = 'filter' and config = 'format_query' then case when tool_case = 2 then 1.0 else 0.0 end
         when family = 'filter' and config = 'format' then case when tool_case in (1, 2) then 1.0 else 0.0 end
         when family = 'filter' then case when tool_case = 1 then 1.0 else 0.0 end
         when family = 'question' then case when tool_case = 0 then 1.0 else 0.0 end
         else 0.0 end::double as tool_choice,
    case when family = 'question' then
      case when len([n for n in numbers if abs(n - truth_row) <= 0.06
             or (truth_row >= 10 and n = truth_row)
             or abs(n - truth_rate) <= 0.06 or (truth_rate >= 10 and n = round_even(truth_rate, 0))]) > 0
           then 1.0 else 0.0 end end::double as answer_correct,
    case when templated then
      case when contains(text, '🎯') and contains(text, '📊') and contains(text, '💡')
             and (dataset <> 'manifest' or contains(text, '<span class="suggestion">'))
           then 1.0 else 0.0 end end::double as format_adherence,
    case honesty when 'honest' then 1.0 when 'wrong' then 0.0 when 'unverified' then 0.0 end::double as number_honesty,
    1 + case tool_case when 0 then 2 when 1 then 1 when 2 then 2 else 0 end as api_calls,
    case when error is null then null when contains(error, 'collapsed') then 'schema: `collapsed` missing'
         when contains(error, 'Failed to parse tool call') then 'malformed tool call'
         when contains(error, 'RateLimit') then 'rate limit (retries exhausted)'
         else left(split_part(error, ':', 1), 40) end as error_kind,
    case provider when '<home>' then model else model || ' @' || provider end as label
  from judged)"""

SUGGESTION_DATASETS = ["manifest"]


def scorable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the columns scoring needs."""
    from tablegauge.functions.tools import expected_tools

    return runs(spark, sf_dir).withColumns({
        "tools": tool_names(), "expected_tools": expected_tools(F.col("family")),
        "truth_rows": F.array("truth_row"), "truth_rates": F.array("truth_rate"),
        "truth_values": F.array(F.col("truth_row").cast("double"), F.col("truth_rate"))})


def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablegauge.operators.scoring import score_runs

    return score_runs(scorable_runs(spark, sf_dir), suggestion_datasets=SUGGESTION_DATASETS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablegauge.operators.scoring import facts as fact_rows

    return fact_rows(scored_runs(spark, sf_dir).withColumn("provider", F.lit(None).cast("string")))


# --- row counts of the generated filters ---------------------------------------------------

COUNTS = """statements as (
  select dataset, rtrim(update_sql, ';') as statement, any_value(k) as k, count(*) as uses
  from runs where update_sql is not null group by 1, 2),
counts as (
  select s.dataset, s.statement, s.uses, case
    when s.dataset = 'labels' then case s.k % 3 when 0 then (select count(*) from labels where quality = 1)
      when 1 then (select count(*) from labels where toxic = 1 or quality = 0) end
    else case s.k % 8
      when 0 then (select count(*) from manifest m
                   where m.lang = case s.k % 3 when 0 then 'de' when 1 then 'en' else 'DE' end)
      when 1 then (select count(*) from manifest m where m.n_chars < s.k * 40)
      when 2 then (select count(*) from manifest m where m.quality = 1 and m.lang = 'en')
      when 4 then (select count(*) from (select lang, count(*) as n from manifest group by lang) g where g.n > s.k)
      end end as n
  from statements s)"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
