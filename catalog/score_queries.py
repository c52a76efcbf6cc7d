"""Queries for scoring generated statements and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tablegauge.functions import errors, replies, tools
from tablegauge.operators import scoring
from tablegauge.operators.statements import (
    bind,
    count_statements,
    distinct_statements,
    run_statement,
    same_answers,
    same_rows,
    with_statement_counts,
)

RUNS = v.with_ctes(v.RUNS)
SCORED = v.with_ctes(v.RUNS, v.SCORED)
COUNTED = v.with_ctes(v.MANIFEST, v.RUNS, v.COUNTS)


@query("C1_allowed_tool_sets", RUNS + """
    select family, config, case
        when family = 'filter' and config = 'format_query' then '<query>,<update>'
        when family = 'filter' and config = 'format'
          then '<update>|<query>,<update>'
        when family = 'filter' then '<update>'
        when family = 'question' then '<query>' else '<reset>' end as allowed,
      count(*) as n from runs group by family, config""")
def allowed_tool_sets(spark, sf_dir):
    r = v.runs(spark, sf_dir).groupBy("family", "config").agg(F.count(F.lit(1)).alias("n"))
    sets = tools.allowed_tool_sets(tools.expected_tools(F.col("family")), F.col("family"), F.col("config"))
    return r.select("family", "config",
                    F.array_join(F.transform(sets, lambda s: F.array_join(s, ",")), "|").alias("allowed"), "n")


@query("C2_tool_sets_equal", v.with_ctes(v.RUNS, v.SCORED) + """
    select run_id, case when family = 'filter' and config = 'format_query' then tool_case = 2
      when family = 'filter' and config = 'format' then tool_case in (1, 2)
      when family = 'filter' then tool_case = 1 when family = 'question' then tool_case = 0 else false end as ok
    from runs""")
def tool_sets_equal(spark, sf_dir):
    return v.scorable_runs(spark, sf_dir).select("run_id", tools.tool_choice_ok(
        F.col("tools"), F.col("expected_tools"), F.col("family"), F.col("config")).alias("ok"))


@query("C3_tool_choice_score", SCORED + "select run_id, tool_choice from scored")
def tool_choice(spark, sf_dir):
    return v.scorable_runs(spark, sf_dir).select("run_id", scoring.tool_choice().alias("tool_choice"))


def statement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"manifest": bind(v.manifest(spark, sf_dir), "manifest"),
              "labels": bind(v.read(spark, sf_dir, "labels"), "labels")}
    return count_statements(distinct_statements(v.runs(spark, sf_dir), "dataset", "update_sql"), tables)


@query("C4_statement_counts", COUNTED + "select dataset, statement, uses, n from counts")
def counts(spark, sf_dir):
    return statement_counts(spark, sf_dir).drop("fault")


def _judged_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the row count of their filter; accepted are the count of German texts and 200 to 400 rows in tens."""
    truth = F.transform(F.sequence(F.lit(20), F.lit(40)), lambda x: (x * 10 + F.col("k") % 3).cast("bigint"))
    judged = v.scorable_runs(spark, sf_dir).withColumn("truth_rows", truth)
    return with_statement_counts(judged, statement_counts(spark, sf_dir), "dataset", "update_sql", spread_by=["run_id"])


_JUDGED = v.with_ctes(v.MANIFEST, v.RUNS, v.COUNTS) + """, judged as (
  select r.*, c.n, coalesce(c.n between 200 and 402 and c.n % 10 = r.k % 3 and c.n <= 400 + r.k % 3, false) as ok
  from runs r left join counts c on r.dataset = c.dataset and rtrim(r.update_sql, ';') = c.statement)"""


@query("C5_filter_rows_ok", _JUDGED + "select run_id, n as statement_rows, ok from judged")
def filter_rows_ok(spark, sf_dir):
    return _judged_filters(spark, sf_dir).select(
        "run_id", "statement_rows",
        F.coalesce(F.array_contains("truth_rows", F.col("statement_rows")), F.lit(False)).alias("ok"))


@query("C5_same_rows_strict", v.with_ctes(v.MANIFEST) + """
    select count(*) filter (lang = 'en' and n_chars >= 500) as missing, 0 as extra,
      count(*) filter (lang = 'en' and n_chars >= 500) = 0 as same from manifest""")
def same_rows_strict(spark, sf_dir):
    table = bind(v.manifest(spark, sf_dir), "manifest")
    return same_rows(run_statement("SELECT * FROM manifest WHERE lang = 'en' AND n_chars < 500", table),
                     run_statement("SELECT * FROM manifest WHERE lang = 'en'", table))


def _agrees(condition: str) -> str:
    return f"(select count(*) filter (coalesce({condition}, false) <> coalesce(m.quality = 1 and m.lang = 'en', false)) = 0 from manifest m)"


@query("C5_same_answers", v.with_ctes(v.MANIFEST, v.RUNS, v.COUNTS) + f"""
    select s.dataset, s.statement, coalesce(case when s.dataset = 'manifest' then case s.k % 8
        when 0 then {_agrees("m.lang = case s.k % 3 when 0 then 'de' when 1 then 'en' else 'DE' end")}
        when 1 then {_agrees("m.n_chars < s.k * 40")} when 2 then true end end, false) as same
    from statements s""")
def same_answers_of_statements(spark, sf_dir):
    """Every statement against one with the right rows, by fingerprints from the scan that counts them."""
    truth = "select * from manifest where 'en' = lang and not quality <> 1"
    tables = {"manifest": bind(v.manifest(spark, sf_dir), "manifest"), "labels": bind(v.read(spark, sf_dir, "labels"), "labels")}
    asked = distinct_statements(v.runs(spark, sf_dir), "dataset", "update_sql")
    wanted = spark.range(1).select(F.lit("manifest").alias("dataset"), F.lit(truth).alias("statement"), F.lit(0).cast("bigint").alias("uses"))
    found = count_statements(asked.unionByName(wanted), tables, fingerprints=True)
    pairs = asked.select("dataset", "statement", F.lit("manifest").alias("truth_dataset"), F.lit(truth).alias("truth"))
    return same_answers(pairs, found).select("dataset", "statement", "same")


@query("C6_filter_score", _JUDGED + """
    select model, config, count(*) as n, sum(case when ok then 1.0 else 0.0 end)::double as right_rows
    from judged where family = 'filter' group by model, config""")
def filter_score(spark, sf_dir):
    scored = _judged_filters(spark, sf_dir).withColumn("s", scoring.filter_rows(F.col("statement_rows")))
    return scored.where(F.col("s").isNotNull()).groupBy("model", "config").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("right_rows"))


_NUMBERS = r"[try_cast(replace(y, ',', '') as double) for y in regexp_extract_all({t}, '(\d[\d,]*(?:\.\d+)?)', 1)]"


@query("C7_numbers_in_replies", RUNS + f"""
    select run_id, len(nums) as n, list_sum(nums) as total, list_max(nums) as highest, nums[1] as first_number
    from (select run_id, {_NUMBERS.format(t='text')} as nums from runs) t""")
def numbers_in_replies(spark, sf_dir):
    return _number_stats(v.runs(spark, sf_dir), "run_id")


@query("C7_numbers_in_documents", f"""
    select doc_id, len(nums) as n, list_max(nums) as highest, nums[1] as first_number
    from (select doc_id, {_NUMBERS.format(t='text')} as nums from documents) t""")
def numbers_in_documents(spark, sf_dir):
    return _number_stats(v.read(spark, sf_dir, "documents"), "doc_id").drop("total")


def _number_stats(frame: DataFrame, key: str) -> DataFrame:
    nums = F.col("nums")
    return frame.select(key, replies.numbers_in(F.col("text")).alias("nums")).select(
        key, F.size(nums).alias("n"),
        F.when(F.size(nums) > 0, F.aggregate(nums, F.lit(0.0), lambda a, x: a + x)).alias("total"),
        F.array_max(nums).alias("highest"), F.get(nums, 0).alias("first_number"))


@query("C8_answer_contains", v.with_ctes(v.RUNS, v.SCORED) + """
    select run_id, len([n for n in numbers if abs(n - truth_row) <= 0.06 or (truth_row >= 10 and n = truth_row)
      or abs(n - truth_rate) <= 0.06 or (truth_rate >= 10 and n = round_even(truth_rate, 0))]) > 0 as ok
    from parsed""")
def answer_contains(spark, sf_dir):
    return v.scorable_runs(spark, sf_dir).select(
        "run_id", replies.answer_contains(F.col("text"), F.col("truth_values")).alias("ok"))


@query("C9_answer_score", SCORED + "select run_id, answer_correct from scored")
def answer_score(spark, sf_dir):
    return v.scorable_runs(spark, sf_dir).select("run_id", scoring.answer_correct().alias("answer_correct"))


@query("C10_template_parts_missing", RUNS + """
    select run_id, concat_ws(',', case when not contains(text, '🎯') then '🎯' end,
        case when not contains(text, '📊') then '📊' end, case when not contains(text, '💡') then '💡' end,
        case when not contains(text, '<span class="suggestion">') then 'suggestion span' end) as missing,
      contains(text, '🎯') and contains(text, '📊') and contains(text, '💡')
        and contains(text, '<span class="suggestion">') as ok from runs""")
def template_missing(spark, sf_dir):
    text = F.col("text")
    return v.runs(spark, sf_dir).select(
        "run_id", F.array_join(replies.template_missing(text), ",").alias("missing"), replies.template_ok(text).alias("ok"))


@query("C11_template_score", SCORED + "select run_id, format_adherence from scored")
def template_score(spark, sf_dir):
    return v.scorable_runs(spark, sf_dir).select(
        "run_id", scoring.format_adherence(v.SUGGESTION_DATASETS).alias("format_adherence"))


@query("C12_stated_statistics", SCORED + "select run_id, said_rows, said_rate from parsed")
def stated_statistics(spark, sf_dir):
    return v.runs(spark, sf_dir).select("run_id", replies.stated_rows(F.col("text")).alias("said_rows"),
                                        replies.stated_rate(F.col("text")).alias("said_rate"))


@query("C13_verdict", SCORED + "select run_id, honesty from scored")
def verdict(spark, sf_dir):
    return v.scorable_runs(spark, sf_dir).select("run_id", scoring.honesty_verdict().alias("honesty"))


@query("C14_honesty_score", SCORED + "select run_id, honesty, number_honesty from scored")
def honesty_score(spark, sf_dir):
    return v.scored_runs(spark, sf_dir).select("run_id", "honesty", "number_honesty")


@query("C15_score_letters", RUNS + """
    select k % 4 as letter, count(*) as n, sum(case k % 4 when 0 then 1.0 when 1 then 0.0 end)::double as total,
      count(case when k % 4 < 2 then 1 end) as applicable from runs group by k % 4""")
def score_letters(spark, sf_dir):
    from tablegauge.sources.runlogs import score_value

    c = F.col("k") % 4
    letter = F.when(c == 0, "C").when(c == 1, "I").when(c == 2, "N")
    return v.runs(spark, sf_dir).select(c.alias("letter"), score_value(letter).alias("s")).groupBy("letter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.count("s").alias("applicable"))


@query("C16_accuracy", SCORED + "select " + ", ".join(
    f"avg({s}) as {s}" for s in ("tool_choice", "answer_correct", "format_adherence", "number_honesty")) + " from scored")
def accuracy(spark, sf_dir):
    return v.scored_runs(spark, sf_dir).agg(*[scoring.accuracy(s).alias(s) for s in
                                              ("tool_choice", "answer_correct", "format_adherence", "number_honesty")])


@query("C17_explanations", _JUDGED + f"""
    select run_id,
      case when error is not null then 'API error: ' || error
        when family = 'filter' and config = 'format_query'
          then 'allowed [[''<query>'', ''<update>'']] under ' || config
        when family = 'filter' and config = 'format'
          then 'allowed [[''<update>''], [''<query>'', ''<update>'']] under ' || config
        when family = 'filter' then 'allowed [[''<update>'']] under ' || config
        when family = 'question' then 'allowed [[''<query>'']] under ' || config
        else 'allowed [[''<reset>'']] under ' || config end as tool_choice_why,
      case when family <> 'filter' then 'not a filter intent'
        when update_sql is null then 'no update_dashboard SQL' when n is null then 'SQL error: ' || update_sql
        else cast(n as varchar) || ' rows (want [' || cast(truth_row as varchar) || ']): ' || update_sql end as filter_rows_why,
      case when family = 'question' then left(text, 200) end as answer_correct_answer,
      case when not (family = 'filter' and config in ('format', 'format_query'))
          then 'format not demanded for this sample'
        when contains(text, '🎯') and contains(text, '📊') and contains(text, '💡') then 'ok'
        when contains(text, '🎯') then 'missing [''💡'']' else 'missing [''🎯'', ''📊'', ''💡'']' end as format_adherence_why
    from judged""")
def explanations(spark, sf_dir):
    why = scoring.explanations(suggestion_datasets=[])
    runs = with_statement_counts(v.scorable_runs(spark, sf_dir), statement_counts(spark, sf_dir),
                                 "dataset", "update_sql", spread_by=["run_id"])
    return runs.select("run_id", *[why[name].alias(name) for name in
                                   ("tool_choice_why", "filter_rows_why", "answer_correct_answer", "format_adherence_why")])


_STATED = "coalesce(cast(said_rows as varchar), 'None') || ' rows / ' || coalesce(cast(said_rate as varchar), 'None') || '%'"
_NEAR = "list_filter(numbers, lambda n: abs(n - {t}) <= 0.06 or ({t} >= 10 and n = round_even({t}, 0)))"
_ROW = "cast(truth_row as double)"


@query("C17_answers_and_reasons", SCORED + f"""
    select run_id, case tool_case when 0 then '[''<schema>'', ''<query>'']' when 1 then '[''<update>'']'
        when 2 then '[''<update>'', ''<query>'']' else '[]' end as tool_choice_answer,
      case when family = 'filter' then coalesce(update_sql, '') end as filter_rows_answer,
      case when family <> 'question' then 'not a question intent'
        when len(row_hits) > 0 then 'found ' || cast(row_hits[1] as varchar) || ' ~ ' || cast({_ROW} as varchar)
        when len(rate_hits) > 0 then 'found ' || cast(rate_hits[1] as varchar) || ' ~ ' || cast(truth_rate as varchar)
        else 'none of [' || cast({_ROW} as varchar) || ', ' || cast(truth_rate as varchar) || '] in ['
          || coalesce(array_to_string(numbers[1:8], ', '), '') || ']' end as answer_correct_why,
      case when templated then left(text, 200) end as format_adherence_answer, honesty as number_honesty_answer,
      case when not templated then 'stats not demanded for this sample' when honesty = 'silent' then 'no stats in reply'
        when honesty = 'wrong' then 'reply ' || {_STATED} || ' vs truth [' || cast(truth_row as varchar) || '] / ['
          || cast(truth_rate as varchar) || ']'
        when honesty = 'unverified' then 'correct ' || {_STATED} || ' but no <query> call'
        else {_STATED} || ' from query' end as number_honesty_why
    from (select *, {_NEAR.format(t=_ROW)} as row_hits, {_NEAR.format(t='truth_rate')} as rate_hits from scored) s""")
def answers_and_reasons(spark, sf_dir):
    why = scoring.explanations(suggestion_datasets=[])
    runs = v.scorable_runs(spark, sf_dir).withColumn("statement_rows", F.lit(None).cast("bigint"))
    return runs.select("run_id", *[why[name].alias(name) for name in (
        "tool_choice_answer", "filter_rows_answer", "answer_correct_why", "format_adherence_answer", "number_honesty_answer",
        "number_honesty_why")])


@query("C_all_scores_in_one_pass", SCORED + """
    select run_id, tool_choice, answer_correct, format_adherence, number_honesty, honesty, error_kind, api_calls, errored
    from scored""")
def all_scores(spark, sf_dir):
    return v.scored_runs(spark, sf_dir).select(
        "run_id", "tool_choice", "answer_correct", "format_adherence", "number_honesty", "honesty",
        errors.error_kind(F.col("error")).alias("error_kind"), tools.api_calls(F.col("tools")).alias("api_calls"),
        errors.has_error(F.col("error")).alias("errored"))
