"""Queries for sources, the dashboard and the SQL constructs its statements use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tablegauge import fixed_values as fv
from tablegauge.operators import dashboard as dash
from tablegauge.operators import profiles
from tablegauge.operators.dashboard import Dashboard
from tablegauge.operators.statements import bind, try_statement
from tablegauge.plans.truth import filter_truth
from tablegauge.sources import runlogs, samples, tables
from tablegauge.workdir import new_path, written

MANIFEST = v.with_ctes(v.MANIFEST)
RUNS = v.with_ctes(v.RUNS)

# --- SQL constructs: the same statement on both engines ----------------------------------

STATEMENTS = {
    "P1_integer_equality": "SELECT count(*) AS n, 100.0 * avg(quality) AS rate FROM manifest WHERE quality = 1",
    "P2_string_equality": "SELECT doc_id, lang, n_chars FROM manifest WHERE lang = 'de'",
    "P2_wrong_case_is_empty": "SELECT doc_id, lang, n_chars FROM manifest WHERE lang = 'DE'",
    "P3_conjunction": "SELECT doc_id, lang, source, quality FROM manifest WHERE lang = 'en' AND quality = 1 AND n_chars < 5000",
    "P4_inequality": "SELECT doc_id, lang FROM manifest WHERE lang <> 'fr'",
    "P5_range_on_nullable": "SELECT doc_id, quality FROM manifest WHERE quality < 1",
    "P6_boolean_equality": "SELECT doc_id, is_toxic FROM manifest WHERE is_toxic = true",
    "P7_full_count": "SELECT count(*) AS n FROM manifest",
    "P8_filtered_count": "SELECT count(*) AS n FROM manifest WHERE lang = 'en' AND quality = 1",
    "P9_mean": "SELECT avg(n_chars) AS mean_chars FROM manifest WHERE lang = 'en'",
    "P10_maximum": "SELECT max(n_chars) AS max_chars FROM manifest",
    "P11_rate": "SELECT 100.0 * avg(quality) AS rate FROM manifest WHERE lang = 'de'",
    "P12_count_and_rate": "SELECT count(*) AS n, 100.0 * avg(quality) AS rate FROM manifest WHERE lang = 'de'",
    "P13_all_columns": "SELECT * FROM manifest WHERE n_chars < 500",
}


def _statement(name: str, text: str) -> None:
    @query(name, MANIFEST + text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Dashboard(v.manifest(spark, sf_dir), "manifest").query(text)


for _name, _text in STATEMENTS.items():
    _statement(_name, _text)


@query("P14_accepted_alternatives", MANIFEST + """
    select 'toxic' as name, count(*) filter (is_toxic = true) as n from manifest union all
    select 'labelled_toxic', count(*) filter (quality is not null and is_toxic) from manifest""")
def alternatives(spark, sf_dir):
    frame = v.manifest(spark, sf_dir)
    return filter_truth(frame, {"toxic": "is_toxic = true", "labelled_toxic": "quality IS NOT NULL AND is_toxic"},
                        "quality").select("name", "n")


# --- dashboard operations ------------------------------------------------------------------


@query("D1_filter_replaces_view", MANIFEST + "select * from manifest where lang = 'de' and n_chars >= 500")
def filter_view(spark, sf_dir):
    board = Dashboard(v.manifest(spark, sf_dir), "manifest")
    board.filter("SELECT * FROM manifest WHERE lang = 'de' AND n_chars >= 500", "German")
    return board.view


@query("D2_query_leaves_view", MANIFEST + """
    select 'answer' as what, count(*) as n from manifest where lang = 'en' union all
    select 'view', count(*) from manifest where lang = 'de'""")
def ad_hoc_query(spark, sf_dir):
    board = Dashboard(v.manifest(spark, sf_dir), "manifest")
    board.filter("SELECT * FROM manifest WHERE lang = 'de'")
    answer = board.query("SELECT count(*) AS n FROM manifest WHERE lang = 'en'")
    shown = board.view.agg(F.count(F.lit(1)).alias("n"))
    return answer.select(F.lit("answer").alias("what"), "n").unionByName(
        shown.select(F.lit("view").alias("what"), "n"))


@query("D3_reset_shows_all", MANIFEST + "select lang, count(*) as n from manifest group by lang")
def reset(spark, sf_dir):
    board = Dashboard(v.manifest(spark, sf_dir), "manifest")
    board.filter("SELECT * FROM manifest WHERE lang = 'de'")
    return board.reset().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_PROFILED = ["doc_id", "lang", "source", "n_chars", "quality", "is_toxic"]


@query("D4_schema_profile", MANIFEST + " union all ".join(
    f"select '{c}' as column_name, count({c}) as filled, count(distinct {c}) as distinct_values, "
    f"cast(min({c}) as varchar) as smallest, cast(max({c}) as varchar) as largest from manifest"
    for c in _PROFILED))
def schema_profile(spark, sf_dir):
    return Dashboard(v.manifest(spark, sf_dir), "manifest").schema(exact=True).drop("type", "meaning")


def _profile_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the whole table, merged from those of three parts that were written one after the other."""
    table, path = v.manifest(spark, sf_dir), new_path(spark, "profiles")
    for part in range(3):
        profiles.profile_state(table.where(F.col("doc_id") % 3 == part)).write.mode("append").parquet(path)
    return profiles.merged(spark.read.parquet(path))


@query("D4_profile_from_states", MANIFEST + " union all ".join(
    f"select '{c}' as column_name, count(*) as n_rows, count({c}) as filled, true as distinct_close, "
    f"{'true' if c in ('doc_id', 'n_chars', 'quality') else 'null::boolean'} as median_close from manifest" for c in _PROFILED))
def profile_from_states(spark, sf_dir):
    """Counts, and estimates within five standard errors (distinct values) and five percent of the ranks (medians)."""
    told, exact = profiles.described(_profile_in_parts(spark, sf_dir)), Dashboard(v.manifest(spark, sf_dir), "manifest").schema(exact=True)
    ranks = v.manifest(spark, sf_dir).agg(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.percentile_approx(c, [0.45, 0.55], 10_000).cast("array<double>").alias("middle"))
        for c in ("doc_id", "n_chars", "quality")]).alias("r")).select(F.inline("r"))
    both = told.join(exact.select("column_name", F.col("distinct_values").alias("exactly")), "column_name").join(ranks, "column_name", "left")
    return both.select("column_name", "n_rows", "filled",
                       (F.abs(F.col("distinct_values") - F.col("exactly")) <= F.greatest(F.lit(1.0), 0.08 * F.col("exactly"))).alias("distinct_close"),
                       F.get("quartiles", F.lit(2)).between(F.get("middle", F.lit(0)), F.get("middle", F.lit(1))).alias("median_close"))


@query("D4_values_from_states", MANIFEST + """
    select 'lang' as column_name, lang as value, count(*) as n from manifest where lang is not null group by lang
    union all select 'is_toxic', cast(is_toxic as varchar), count(*) from manifest where is_toxic is not null group by is_toxic
    union all select 'quality', cast(quality as varchar), count(*) from manifest where quality is not null group by quality
    union all select 'source', source, count(*) from manifest
      where source is not null and (select count(distinct source) from manifest) <= 20 group by source
    union all select 'source', null, null where (select count(distinct source) from manifest) > 20
    union all select 'doc_id', null, null union all select 'n_chars', null, null""")
def values_from_states(spark, sf_dir):
    """Values of the columns with few, and the others by name."""
    return profiles.vocabulary(_profile_in_parts(spark, sf_dir), 20).drop("distinct_values")


@query("D4_low_cardinality_values", MANIFEST + """
    select 'lang' as column_name, lang as value, count(*) as n from manifest where lang is not null group by lang
    union all select 'is_toxic', cast(is_toxic as varchar), count(*) from manifest
      where is_toxic is not null group by is_toxic
    union all select 'source', source, count(*) from manifest
      where source is not null and (select count(distinct source) from manifest) <= 20 group by source""")
def low_cardinality(spark, sf_dir):
    return dash.vocabulary_values(v.manifest(spark, sf_dir), limit=20)


# Words of the dictionary with the condition each stands for.
_WORDS = {"short": "n_chars < 500", "german": "lang = 'de'", "good": "quality = 1", "harmful": "is_toxic = true"}


@query("D5_vocabulary", MANIFEST + " union all ".join(
    f"select '{w}' as term, count(*) filter ({p}) as n from manifest" for w, p in _WORDS.items()))
def vocabulary(spark, sf_dir):
    frame = dash.with_meanings(v.manifest(spark, sf_dir), {"n_chars": "length of the text", "quality": "1 is good"})
    return filter_truth(frame, _WORDS, "quality").select(F.col("name").alias("term"), "n")


_MEANINGS = {"n_chars": "length of the text", "quality": "1 is good", "lang": "language of the text"}
_TYPES = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "is_toxic": "boolean"}


@query("D5_described_columns", MANIFEST + " union all ".join(
    f"select '{c}' as column_name, '{kind}' as type, {repr(_MEANINGS[c]) if c in _MEANINGS else 'null::varchar'} as meaning, "
    f"count({c}) as filled from manifest" for c, kind in _TYPES.items()))
def described_columns(spark, sf_dir):
    described = dash.with_meanings(v.manifest(spark, sf_dir), _MEANINGS)
    return dash.profile(described).select("column_name", "type", "meaning", "filled")


@query("D6_last_update_wins", RUNS + """
    select model, arg_max(update_sql, run_id) filter (update_sql is not null) as statement from runs group by model""")
def last_update(spark, sf_dir):
    return dash.last_updates(v.runs(spark, sf_dir), ["model"], "update_sql", "run_id").withColumnRenamed("update_sql", "statement")


@query("D7_title_with_fallback", """
    select title, count(*) as n from (
      select case when lang = 'de' or lang is null then 'documents dataset' else 'Only ' || lang end as title
      from documents) t group by title""")
def title(spark, sf_dir):
    asked = F.when(F.col("lang") == "de", F.lit("")).otherwise(F.concat(F.lit("Only "), F.col("lang")))
    return (v.read(spark, sf_dir, "documents").select(dash.title_or_default(asked, "documents dataset").alias("title"))
            .groupBy("title").agg(F.count(F.lit(1)).alias("n")))


_REFUSED = [
    "DROP TABLE manifest", "DELETE FROM manifest", "SHOW TABLES", "SELECT 1; SELECT 2", "SELECT * FROM manifest) q, (SELECT 1",
    "SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', -1)",
    r"SELECT '\' -- ' AS a, reflect('java.lang.Math', 'abs', -1)", "SELECT try_reflect/* */('java.lang.Math', 'abs', -1)",
    "SELECT * FROM manifest WHERE EXISTS (SELECT java_method('java.lang.Math', 'abs', n_chars))",
    "SELECT * FROM all_documents", "SELECT * FROM global_temp.all_documents", "SELECT lang FROM manifest WHERE n_chars > (SELECT min(doc_id) FROM all_documents)",
    "SELECT shout(lang) FROM manifest", "SELECT input_file_name() FROM manifest", "SELECT current_user(), version()",
]


@query("D8_read_only_gate", MANIFEST + "select lang, count(*) as n, 0 as accepted from manifest group by lang")
def gate(spark, sf_dir):
    """What no statement may do, with views and functions in the session that it must not reach."""
    documents = v.read(spark, sf_dir, "documents")
    documents.createOrReplaceTempView("all_documents")
    documents.createOrReplaceGlobalTempView("all_documents")
    spark.udf.register("shout", lambda text: text.upper())
    table = bind(v.manifest(spark, sf_dir), "manifest")
    accepted = sum(try_statement(text, table) is not None for text in _REFUSED)
    allowed = try_statement("WITH a AS (SELECT * FROM manifest) SELECT lang, count(*) AS n FROM a GROUP BY lang;", table)
    return allowed.withColumn("accepted", F.lit(accepted))


# --- sources and sinks -----------------------------------------------------------------------


@query("S1_load_table", """
    select source, count(*) as n, avg(length(text)) as mean_length, max(n_chars) as max_chars
    from documents group by source""")
def load_table(spark, sf_dir):
    return tables.load_table(spark, f"{sf_dir}/documents.parquet").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_length"), F.max("n_chars").alias("max_chars"))


@query("S1_missing_numbers_are_null", """
    select event_type, count(case when value > 10 then value end) as filled,
      avg(case when value > 10 then cast(floor(value * 100) as bigint) end) as mean_cents
    from events group by event_type""")
def missing_numbers(spark, sf_dir):
    raw = v.read(spark, sf_dir, "events").withColumn(
        "value", F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(float("nan"))))
    return tables.nan_to_null(raw).groupBy("event_type").agg(
        F.count("value").alias("filled"), F.avg(F.floor(F.col("value") * 100)).alias("mean_cents"))


@query("S2_run_length_table", """
    select planet, crew_role, survived_crash, count(*) as n, sum(age) as ages from (
      select case when i < 30 then 'Zorgon' when i < 50 then 'Xylpha' else 'Brimtak' end as planet,
        case when i < 10 or i between 30 and 37 or i between 50 and 74 then 'pilot' else 'medic' end as crew_role,
        case when i < 18 or i between 30 and 34 or i between 50 and 84 then 1 else 0 end as survived_crash,
        case when i < 30 then i + 20 when i < 50 then i - 5 else i - 32 end as age
      from (select event_id % 100 as i from events) e) t
    group by planet, crew_role, survived_crash""")
def run_length_table(spark, sf_dir):
    rows = v.read(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("i"))
    return tables.with_crash_columns(rows, F.col("i")).groupBy("planet", "crew_role", "survived_crash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("age").alias("ages"))


@query("S3_table_by_name", MANIFEST + """
    select 'manifest' as name, count(*) as n, sum(quality) as metric from manifest union all
    select 'labels', count(*), sum(toxic) from labels""")
def table_by_name(spark, sf_dir):
    registry = tables.Registry(spark)
    registry.add("manifest", lambda: v.manifest(spark, sf_dir), "quality")
    registry.add("labels", lambda: v.read(spark, sf_dir, "labels"), "toxic")
    parts = [registry.table(name).frame.agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(registry.metric[name]).alias("metric"))
        for name in ("manifest", "labels")]
    return parts[0].unionByName(parts[1])


@query("S4_bound_name", """
    select n_regionkey as region, count(*) as suppliers from supplier s
    join nation n on s.s_nationkey = n.n_nationkey group by n_regionkey""")
def bound_name(spark, sf_dir):
    joined = v.read(spark, sf_dir, "supplier").join(
        v.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return Dashboard(joined, "homes").query(
        "SELECT n_regionkey AS region, count(*) AS suppliers FROM homes GROUP BY n_regionkey")


def _document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per document, as its reply checks would be stored."""
    d = v.read(spark, sf_dir, "documents")
    target = F.to_json(F.struct(F.array("n_chars").alias("rows"), F.array(F.lit(50.0)).alias("rates"),
                                F.array(F.lit(1.5)).alias("values")))
    return d.select(
        F.concat_ws(":", F.lit("documents"), "lang", F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("show "), "source").alias("input"), target.alias("target"),
        F.struct(F.col("source").alias("dataset"), F.col("lang").alias("intent"), F.lit("filter").alias("family"),
                 F.lit(0).alias("variant"), F.lit(False).alias("trap"), F.lit(False).alias("rate"),
                 F.array(F.lit(fv.UPDATE_TOOL)).alias("expected_tools"), F.array(F.lit("x = 1")).alias("truth_sql"),
                 F.array("n_chars").alias("truth_rows"), F.array(F.lit(50.0)).alias("truth_rates"),
                 F.array(F.lit(1.5)).alias("truth_values")).alias("metadata"))


@query("S5_S6_samples_as_json_lines", """
    select source as dataset, lang as intent, count(*) as n, sum(n_chars) as row_total,
      count(distinct 'documents:' || lang || ':' || cast(doc_id as varchar)) as ids
    from documents group by source, lang""")
def sample_files(spark, sf_dir):
    path = new_path(spark, "samples")
    samples.write_samples(_document_samples(spark, sf_dir), path)
    stored = samples.read_samples(spark, path)
    return stored.groupBy("metadata.dataset", "metadata.intent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get("truth.rows", F.lit(0))).alias("row_total"),
        F.count_distinct("id").alias("ids"))


_LOGS_SQL = """logs as (
  select *, case when run_id % 100 < 50 then 'success' else 'error' end as status from runs)"""


def logged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as logged samples, with scores as letters."""
    from tablegauge.functions.tools import expected_tools

    r = v.runs(spark, sf_dir)
    letter = F.when(F.col("k") % 3 == 0, "C").when(F.col("k") % 3 == 1, "I").otherwise("N")

    def score(name: str):
        return [F.lit(name), F.struct(letter.alias("value"), F.create_map(
            F.lit("verdict"), F.element_at(F.array(*[F.lit(x) for x in fv.VERDICTS]), F.col("tool_case") + 1))
            .alias("metadata"))]

    metadata = F.struct(
        "dataset", "intent", "family", F.lit(0).alias("variant"), "trap", F.lit(False).alias("rate"),
        expected_tools(F.col("family")).alias("expected_tools"), F.array().cast("array<string>").alias("truth_sql"),
        F.array("truth_row").alias("truth_rows"), F.array("truth_rate").alias("truth_rates"),
        F.array().cast("array<double>").alias("truth_values"))
    store = F.struct(
        v.tool_names().alias("tools"), "update_sql", F.array().cast("array<string>").alias("query_sql"), "text",
        "error", F.lit(False).alias("reset"), "retries", "tokens_in", "tokens_out",
        F.lit(0).cast("bigint").alias("tokens_cached"), F.col("full_model").alias("model"), "config", "reasoning",
        "provider")
    return r.select(
        "run_id", F.when(F.col("run_id") % 100 < 50, "success").otherwise("error").alias("status"),
        F.col("started").alias("created"), F.lit(3).alias("epochs"), F.lit(1).alias("max_samples"),
        F.struct(F.col("full_model").alias(fv.MODEL_KEY), "provider", "config", "dataset", "reasoning").alias("metadata"),
        F.struct(F.col("run_id").cast("string").alias("id"), "input", "epoch", metadata.alias("metadata"),
                 store.alias("store"), F.create_map(*score("tool_choice"), *score("number_honesty")).alias("scores"))
        .alias("sample"))


def nested_logs_path(spark: SparkSession, sf_dir: str) -> str:
    """Nested logs of one sample each, written anew for each reader."""
    path = new_path(spark, "logs")
    (logged_samples(spark, sf_dir).withColumn("samples", F.array("sample"))
     .select("status", "created", "epochs", "max_samples", "metadata", "samples").write.json(path))
    return path


@query("S7_read_successful_logs", v.with_ctes(v.RUNS, _LOGS_SQL) + """
    select case provider when '<home>' then model else model || ' @' || provider end as model, config,
      count(*) as n, sum(case when k % 3 = 0 then 1 when k % 3 = 1 then 0 end)::double as correct,
      count(case when k % 3 <> 2 then 1 end) as scored, sum(retries) as retries, count(error) as errors
    from logs where status = 'success' group by 1, 2""")
def read_logs(spark, sf_dir):
    logs = runlogs.read_logs(spark, nested_logs_path(spark, sf_dir))
    rows = runlogs.facts_from_logs(runlogs.successful(runlogs.log_samples(logs)))
    return rows.groupBy("model", "config").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tool_choice").alias("correct"), F.count("tool_choice").alias("scored"),
        F.sum("retries").alias("retries"), F.count_if("error").alias("errors"))


@query("S8_read_logs_of_any_status", v.with_ctes(v.RUNS, _LOGS_SQL) + """
    select full_model as model, count(*) as n, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out
    from logs group by full_model""")
def read_all_logs(spark, sf_dir):
    logs = runlogs.read_logs(spark, nested_logs_path(spark, sf_dir))
    return runlogs.usage_from_logs(runlogs.log_samples(logs)).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query("S9_facts_as_csv", v.with_ctes(v.RUNS, v.SCORED) + """
    select model, config, count(*) as n, sum(tool_choice) as right_tools, count(honesty) as judged
    from scored group by model, config""")
def facts_csv(spark, sf_dir):
    path = new_path(spark, "facts")
    rows = v.facts(spark, sf_dir)
    runlogs.write_facts(rows, path)
    return (spark.read.schema(rows.schema).option("header", True).csv(path).groupBy("model", "config")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("tool_choice").alias("right_tools"),
                 F.count("honesty").alias("judged")))


@query("S10_report_tables", v.with_ctes(v.RUNS, v.SCORED) + """
    select 'errors' as report, model, sum(cast(errored as int))::bigint as value from scored group by model union all
    select 'requests', model, count(*) from scored group by model""")
def report_files(spark, sf_dir):
    from tablegauge.plans import report

    path = new_path(spark, "reports")
    cells = written(report.cells(v.facts(spark, sf_dir), ["model"]), "cells")
    runlogs.write_reports({"errors": cells.select("model", F.col("errors").alias("value")),
                           "requests": cells.select("model", F.col("requests").alias("value"))}, path)
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("report"), "model", "value")
             for name in ("errors", "requests")]
    return parts[0].unionByName(parts[1])


@query("S11_reused_table", MANIFEST + """
    select 'good' as name, count(*) as n from manifest where quality = 1 union all
    select 'short', count(*) from manifest where n_chars < 500""")
def reused_table(spark, sf_dir):
    with tables.Registry(spark) as registry:
        registry.add("manifest", lambda: v.manifest(spark, sf_dir), "quality")
        table = registry.table("manifest", keep=True)
        good = Dashboard(table.frame, "manifest").query("SELECT count(*) AS n FROM manifest WHERE quality = 1")
        short = Dashboard(table.frame, "manifest").query("SELECT count(*) AS n FROM manifest WHERE n_chars < 500")
        both = good.select(F.lit("good").alias("name"), "n").unionByName(short.select(F.lit("short").alias("name"), "n"))
        return written(both, "reused")
