"""Queries for truth values and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tablegauge.functions.tools import expected_tools
from tablegauge.operators.statements import bind
from tablegauge.plans import truth

MANIFEST = v.with_ctes(v.MANIFEST)

# Intents over the manifest view; conditions and statements are the same text on both engines.
FILTERS = {
    "german": "lang = 'de'", "good": "quality = 1", "english_good": "lang = 'en' and quality = 1",
    "not_french": "lang <> 'fr'", "short": "n_chars < 500", "toxic": "is_toxic = true", "wrong_case": "lang = 'DE'",
}
QUESTIONS = {
    "count_total": "SELECT count(*) FROM manifest",
    "mean_english": "SELECT avg(n_chars) FROM manifest WHERE lang = 'en'",
    "longest": "SELECT max(n_chars) FROM manifest",
    "rate_german": "SELECT 100.0 * avg(quality) FROM manifest WHERE lang = 'de'",
    "longest_source": "SELECT max(n) FROM (SELECT source, count(*) AS n FROM manifest GROUP BY source) s",
}
SPECS = [
    {"intent": "german", "family": "filter", "truth_sql": "lang = 'de'", "phrasings": ["only German", "auf Deutsch"]},
    {"intent": "harmful", "family": "filter", "trap": True, "phrasings": ["harmful ones"],
     "truth_sql": ["is_toxic = true", "quality = 0"]},
    {"intent": "longest", "family": "question", "truth_sql": "SELECT max(n_chars) FROM manifest",
     "phrasings": ["longest text?", "max length", "how long is the longest"]},
    {"intent": "rate_german", "family": "question", "rate": True, "phrasings": ["how good is German?"],
     "truth_sql": "SELECT 100.0 * avg(quality) FROM manifest WHERE lang = 'de'"},
    {"intent": "reset", "family": "reset", "phrasings": ["start over", "reset"]},
    {"intent": "weather", "family": "out_of_scope", "phrasings": ["will it rain?"]},
]


def _filter_sql(filters: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{name}' as name, count(*) as n, 100.0 * avg(quality) as rate, "
        f"cast(printf('%.1f', 100.0 * avg(quality)) as double) as rate_1, count(*) = 0 as empty_selection "
        f"from manifest where {p}" for name, p in filters.items())


@query("T1_filter_truth", MANIFEST + _filter_sql(FILTERS))
def filter_truth(spark, sf_dir):
    return truth.filter_truth(v.manifest(spark, sf_dir), FILTERS, "quality").drop("position", "predicate")


MANY = {f"below_{i * 400}": f"n_chars < {i * 400}" for i in range(1, 51)}


@query("T1_fifty_predicates", MANIFEST + """
    select 'below_' || cast(i * 400 as varchar) as name, count(*) filter (n_chars < i * 400) as n,
      100.0 * avg(quality) filter (n_chars < i * 400) as rate
    from manifest, range(1, 51) r(i) group by i""")
def fifty_predicates(spark, sf_dir):
    return truth.filter_truth(v.manifest(spark, sf_dir), MANY, "quality").select("name", "n", "rate")


# Conditions of four kinds over four columns, written i times each with other constants.
_KINDS = ["n_chars < {a}", "lang = '{l}' and n_chars >= {b}", "quality = {q} or n_chars between {b} and {a}", "source <> 'src{q}' and not is_toxic"]
FIVE_HUNDRED = {f"c{i}": _KINDS[i % 4].format(a=40 * i, b=20 * i, q=i % 2, l=("en", "de", "fr", "DE")[i // 4 % 4]) for i in range(500)}


@query("T1_five_hundred_conditions", MANIFEST + """
    select 'c' || i as name, count(*) as n, 100.0 * avg(quality) as rate
    from manifest, (select unnest(range(500)) as i) r
    where case i % 4 when 0 then n_chars < 40 * i
      when 1 then lang = ['en', 'de', 'fr', 'DE'][i // 4 % 4 + 1] and n_chars >= 20 * i
      when 2 then quality = i % 2 or n_chars between 20 * i and 40 * i
      else source <> 'src' || (i % 2) and not is_toxic end
    group by i""")
def five_hundred_conditions(spark, sf_dir):
    """All of them in one scan of the table; those that select nothing are left out here."""
    found = truth.filter_truth(v.manifest(spark, sf_dir), FIVE_HUNDRED, "quality")
    return found.where("n > 0").select("name", "n", "rate")


@query("T2_question_truth", MANIFEST + " union all ".join(
    f"select '{name}' as name, x as value, cast(printf('%.2f', x) as double) as value_2 "
    f"from (select cast(({text}) as double) as x) q" for name, text in QUESTIONS.items()))
def question_truth(spark, sf_dir):
    table = bind(v.manifest(spark, sf_dir), "manifest")
    return truth.question_truth(table, QUESTIONS).select("name", "value", "value_2")


@query("T3_text_or_list", """
    select lang, sum(case when quality is null then 0 else 1 end) as items
    from (select d.lang, l.quality from documents d left join labels l on d.doc_id = l.doc_id) m group by lang""")
def text_or_list(spark, sf_dir):
    texts = v.manifest(spark, sf_dir).select("lang", truth.as_list(F.col("quality").cast("string")).alias("texts"))
    return texts.groupBy("lang").agg(F.sum(F.size("texts")).cast("bigint").alias("items"))


@query("T3_lists_of_texts", MANIFEST + """
    select lang, sum(case when quality is null then 0 else 2 end)::bigint as items, count(*) filter (quality is null) as none
    from manifest group by lang""")
def lists_of_texts(spark, sf_dir):
    listed = F.when(F.col("quality").isNotNull(), F.array(F.col("source"), F.col("quality").cast("string")))
    texts = v.manifest(spark, sf_dir).select("lang", truth.as_list(listed, listed=True).alias("texts"))
    return texts.groupBy("lang").agg(F.sum(F.size("texts")).cast("bigint").alias("items"), F.count_if(F.size("texts") == 0).alias("none"))


@query("T4_T5_sample_per_phrasing", """
    select 'conversations:' || cast(conv_id as varchar) || ':' || cast(p as varchar) as id, p as variant, phrasing as input
    from (select distinct conv_id from conversations) c,
      (values (0, 'show it'), (1, 'only that'), (2, 'filter please')) f(p, phrasing)""")
def sample_per_phrasing(spark, sf_dir):
    intents = v.read(spark, sf_dir, "conversations").select("conv_id").distinct()
    phrasings = F.array(F.lit("show it"), F.lit("only that"), F.lit("filter please"))
    return intents.select("conv_id", F.posexplode(phrasings).alias("variant", "input")).select(
        truth.sample_id(F.lit("conversations"), F.col("conv_id"), F.col("variant")).alias("id"), "variant", "input")


@query("T6_target_as_json", """
    select doc_id, '{"rows":[' || n_chars || '],"rates":[12.5],"values":[]}' as target from documents""")
def target_as_json(spark, sf_dir):
    return v.read(spark, sf_dir, "documents").select("doc_id", truth.target_json(
        F.array("n_chars"), F.array(F.lit(12.5)), F.array().cast("array<double>")).alias("target"))


@query("T7_expected_tools", v.with_ctes(v.RUNS) + """
    select family, case family when 'filter' then '<update>'
      when 'question' then '<query>' else '<reset>' end as tools, count(*) as n
    from runs group by family""")
def tools_of_family(spark, sf_dir):
    return (v.runs(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
            .select("family", F.array_join(expected_tools(F.col("family")), ",").alias("tools"), "n"))


@query("T8_missing_flag_is_false", """
    select coalesce(l.toxic = 1, false) as flag, count(*) as n
    from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def missing_flag(spark, sf_dir):
    return (v.manifest(spark, sf_dir).select(truth.flag(F.col("is_toxic")).alias("flag"))
            .groupBy("flag").agg(F.count(F.lit(1)).alias("n")))


_SAMPLES_SQL = MANIFEST + """, truth as (
  select 'german' as intent, 'filter' as family, false as trap, false as rate, 2 as phrasings,
    (select '[' || count(*) || ']' from manifest where lang = 'de') as truth_rows,
    (select '[' || printf('%.1f', 100.0 * avg(quality)) || ']' from manifest where lang = 'de') as truth_rates,
    '[]' as truth_values
  union all select 'harmful', 'filter', true, false, 1,
    (select '[' || count(*) filter (is_toxic) || ',' || count(*) filter (quality = 0) || ']' from manifest),
    (select '[' || printf('%.1f', 100.0 * avg(quality) filter (is_toxic)) || ','
      || printf('%.1f', 100.0 * avg(quality) filter (quality = 0)) || ']' from manifest), '[]'
  union all select 'longest', 'question', false, false, 3, '[]', '[]',
    (select '[' || max(n_chars) || '.0]' from manifest)
  union all select 'rate_german', 'question', false, true, 1, '[]', '[]',
    (select '[' || printf('%.2f', 100.0 * avg(quality)) || ']' from manifest where lang = 'de')
  union all select 'reset', 'reset', false, false, 2, '[]', '[]', '[]'
  union all select 'weather', 'out_of_scope', false, false, 1, '[]', '[]', '[]')"""


@query("T9_samples_per_family", _SAMPLES_SQL + """
    select 'manifest' as dataset, family, sum(phrasings)::bigint as samples from truth group by family""")
def samples_per_family(spark, sf_dir):
    return truth.family_counts(truth.build_samples(bind(v.manifest(spark, sf_dir), "manifest"), SPECS, "quality"))


@query("T10_samples_with_truth", _SAMPLES_SQL + """
    select 'manifest:' || intent || ':' || cast(i as varchar) as id, family, trap, rate, truth_rows, truth_rates,
      case when truth_values like '%0]' and truth_values not like '%.0]' then
        replace(truth_values, '0]', ']') else truth_values end as truth_values
    from truth, range(0, 3) r(i) where i < phrasings""")
def samples_with_truth(spark, sf_dir):
    built = truth.build_samples(bind(v.manifest(spark, sf_dir), "manifest"), SPECS, "quality")
    return built.select("id", "metadata.family", "metadata.trap", "metadata.rate",
                        *[F.to_json(f"metadata.{c}").alias(c) for c in ("truth_rows", "truth_rates", "truth_values")])
