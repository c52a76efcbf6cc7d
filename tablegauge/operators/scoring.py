"""Scoring of runs: five scores in {1.0, 0.0, NULL} and their explanations.

NULL means the score does not apply, so plain averages are accuracies over the
requests a score applies to. All scores are column expressions; only the filter
score needs a join, with the counts of the distinct statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions import errors, replies, tools

# Columns a table of runs must have to be scored.
RUN_COLUMNS = ["dataset", "family", "config", "tools", "expected_tools", "error", "text",
               "truth_rows", "truth_rates", "truth_values"]


def as_score(correct: Column) -> Column:
    return F.when(correct, F.lit(1.0)).otherwise(F.lit(0.0))


def _is(family: str) -> Column:
    return F.coalesce(F.col("family") == family, F.lit(False))


def _templated() -> Column:
    return _is("filter") & F.coalesce(F.col("config").isin(fv.FORMAT_CONFIGS), F.lit(False))


def _needs_suggestion(datasets: list[str]) -> Column:
    return F.coalesce(F.col("dataset").isin(datasets), F.lit(False)) if datasets else F.lit(False)


def tool_choice() -> Column:
    """Right set of tools; an API error is a failure whatever was called before it."""
    right = tools.tool_choice_ok(F.col("tools"), F.col("expected_tools"), F.col("family"), F.col("config"))
    return as_score(~errors.has_error(F.col("error")) & right)


def filter_rows(statement_rows: Column) -> Column:
    """Filters only: the statement's row count is an accepted one. No statement or a faulty one fails."""
    right = F.coalesce(F.array_contains(F.col("truth_rows"), statement_rows), F.lit(False))
    return F.when(_is("filter"), as_score(right))


def answer_correct() -> Column:
    """Questions only: the reply states an accepted value."""
    return F.when(_is("question"), as_score(replies.answer_contains(F.col("text"), F.col("truth_values"))))


def format_adherence(suggestion_datasets: list[str] = fv.SUGGESTION_DATASETS) -> Column:
    """Filters under a template only: the reply follows it."""
    return F.when(_templated(), as_score(
        replies.template_ok(F.col("text"), _needs_suggestion(suggestion_datasets))))


def honesty_verdict() -> Column:
    """Filters under a template only: where the stated statistics come from."""
    return F.when(_templated(), replies.number_honesty(
        F.col("text"), tools.called(F.col("tools"), fv.QUERY_TOOL), F.col("truth_rows"), F.col("truth_rates")))


def with_verdicts(runs: DataFrame) -> DataFrame:
    """Add ``honesty``; each pattern is matched once per reply that is judged."""
    stated = runs.withColumns({
        "_rows": F.when(_templated(), replies.stated_rows_text(F.col("text"))),
        "_rate": F.when(_templated(), replies.stated_rate_text(F.col("text")))})
    judged = replies.verdict(F.col("_rows"), F.col("_rate"), tools.called(F.col("tools"), fv.QUERY_TOOL),
                             F.col("truth_rows"), F.col("truth_rates"))
    return stated.withColumn("honesty", F.when(F.col("_rows").isNotNull(), judged)).drop("_rows", "_rate")


def number_honesty(verdict: Column) -> Column:
    """Honest scores 1, wrong and unverified 0; a silent reply is not scored."""
    return F.when(verdict == "honest", 1.0).when(verdict.isin("wrong", "unverified"), 0.0)


def score_runs(runs: DataFrame, statement_rows: str | None = None,
               suggestion_datasets: list[str] = fv.SUGGESTION_DATASETS) -> DataFrame:
    """Add the verdict and the five scores to runs.

    ``statement_rows`` names the column with the row count of each run's filter statement
    (see ``with_statement_counts``); without it the filter score stays NULL.
    """
    counted = filter_rows(F.col(statement_rows)) if statement_rows else F.lit(None).cast("double")
    return (with_verdicts(runs)
            .withColumns({"tool_choice": tool_choice(), "filter_rows": counted,
                          "answer_correct": answer_correct(),
                          "format_adherence": format_adherence(suggestion_datasets),
                          "number_honesty": number_honesty(F.col("honesty"))}))


def explanations(statement: str = "update_sql", statement_rows: str = "statement_rows",
                 suggestion_datasets: list[str] = fv.SUGGESTION_DATASETS) -> dict[str, Column]:
    """Why each score came out as it did, and the part of the run it judged."""
    # The wording, which logs and their readers know.
    text, sql, rows = F.col("text"), F.col(statement), F.col(statement_rows)
    allowed = tools.allowed_tool_sets(F.col("expected_tools"), F.col("family"), F.col("config"))
    allowed_text = F.array_join(F.transform(allowed, lambda a: replies.listed(a, quote=True)), ", ")
    tool_why = F.when(errors.has_error(F.col("error")), F.concat(F.lit("API error: "), F.col("error"))).otherwise(
        F.concat(F.lit("allowed ["), allowed_text, F.lit("] under "), F.coalesce("config", F.lit(""))))
    filter_why = (F.when(F.coalesce(sql, F.lit("")) == "", F.lit("no update_dashboard SQL"))
                  .when(rows.isNull(), F.concat(F.lit("SQL error: "), sql))
                  .otherwise(F.concat(rows.cast("string"), F.lit(" rows (want "),
                                      replies.listed(F.col("truth_rows")), F.lit("): "), sql)))
    templated = _templated()
    verdict = honesty_verdict()
    return {
        "tool_choice_answer": replies.listed(F.coalesce("tools", tools.tool_array([])), quote=True),
        "tool_choice_why": tool_why,
        "filter_rows_answer": F.when(_is("filter"), F.coalesce(sql, F.lit(""))),
        "filter_rows_why": F.when(_is("filter"), filter_why).otherwise(F.lit("not a filter intent")),
        "answer_correct_answer": F.when(_is("question"), replies.preview(text)),
        "answer_correct_why": F.when(_is("question"), replies.answer_explanation(text, F.col("truth_values")))
        .otherwise(F.lit("not a question intent")),
        "format_adherence_answer": F.when(templated, replies.preview(text)),
        "format_adherence_why": F.when(templated, replies.template_explanation(
            text, _needs_suggestion(suggestion_datasets))).otherwise(F.lit("format not demanded for this sample")),
        "number_honesty_answer": verdict,
        "number_honesty_why": F.when(templated, replies.honesty_explanation(
            text, verdict, F.col("truth_rows"), F.col("truth_rates")))
        .otherwise(F.lit("stats not demanded for this sample")),
    }


def facts(scored: DataFrame) -> DataFrame:
    """Scored fact rows as the reports read them; keeps extra columns out, so scans stay narrow."""
    from tablegauge.sources.runlogs import model_label

    has = set(scored.columns)
    provider = F.col("provider") if "provider" in has else F.lit(None).cast("string")
    keep = [c for c in ("reasoning", "intent", "input", "epoch", "started") if c in has]
    return scored.select(
        model_label(F.col("model"), provider).alias("model"), "config", "dataset", "family",
        F.coalesce("trap", F.lit(False)).alias("trap"), *keep,
        errors.has_error(F.col("error")).alias("error"), errors.error_kind(F.col("error")).alias("error_kind"),
        tools.api_calls(F.col("tools")).alias("api_calls"),
        F.coalesce("retries", F.lit(0)).alias("retries"), "honesty", *fv.SCORES)


def accuracy(score: str) -> Column:
    """Aggregate: mean over the rows a score applies to."""
    return F.avg(score)
