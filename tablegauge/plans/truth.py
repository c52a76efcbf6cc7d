"""Truth values: what a predicate selects and what a question's answer is."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.functions.rounding import round_exact
from tablegauge.functions.tools import expected_tools
from tablegauge.operators import predicates
from tablegauge.operators.statements import (
    GATE_SETTINGS,
    STATEMENT_FAULTS,
    Binding,
    body_of,
    empty_like,
    judged,
    scan_groups,
)
from tablegauge.sources.schemas import SPEC_SCHEMA
from tablegauge.workdir import session_settings, small_table

# Conditions per scan, by number and by length of text.
PER_SCAN = 32
CHARACTERS_PER_SCAN = 1200


def filter_truth(frame: DataFrame, conditions: Mapping[str, str] | Sequence[tuple[str, str]],
                 metric: str) -> DataFrame:
    """For each named condition: rows selected and the rate of a 0/1 metric in percent.

    Conditions that compare columns with constants are counted in one scan, however many they are (see ``predicates``).
    Others share scans as filtered aggregates, up to ``PER_SCAN`` of them. An empty selection has no rate.
    """
    items = list(conditions.items()) if isinstance(conditions, Mapping) else list(conditions)
    texts = [text for _, text in items]
    with session_settings(frame.sparkSession, GATE_SETTINGS):
        trees = predicates.analysed(empty_like(frame), texts)
        known = {i: found for i, tree in enumerate(trees) if (found := predicates.indexed(texts[i], tree))}
        others = [i for i in range(len(items)) if i not in known]
        parts = _counted_in_cells(frame, items, known, metric) if known else []
        for group in scan_groups([texts[i] for i in others], PER_SCAN, CHARACTERS_PER_SCAN) if others else []:
            some = [others[i] for i in group]
            wide = frame.agg(*[
                F.expr(f"{call} FILTER (WHERE (\n{texts[i]}\n))").alias(f"{name}{i}")
                for i in some for call, name in (("count(*)", "n"), (f"avg(`{metric}`)", "m"))])
            rows = [F.struct(*_named(items, i), F.col(f"n{i}").alias("n"), (100.0 * F.col(f"m{i}")).alias("rate")) for i in some]
            parts.append(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return _union(parts).withColumn("rate_1", round_exact(F.col("rate"), 1)).withColumn(
        "empty_selection", F.col("n") == 0)


def _named(items: Sequence[tuple[str, str]], i: int) -> list[Column]:
    return [F.lit(i).alias("position"), F.lit(items[i][0]).alias("name"), F.lit(items[i][1]).alias("predicate")]


def _counted_in_cells(frame: DataFrame, items: Sequence[tuple[str, str]], known: Mapping[int, predicates.Condition],
                      metric: str) -> list[DataFrame]:
    positions, value = list(known), F.col(f"`{metric}`")
    measures = {"total": value.cast("double"), "filled": value.isNotNull().cast("bigint")}
    found = _union(predicates.matches(frame, list(known.values()), measures))
    asked = small_table(frame.sparkSession, [{"position": i, "name": items[i][0], "predicate": items[i][1], "at": at}
                                             for at, i in enumerate(positions)], "position: int, name: string, predicate: string, at: int")
    told = asked.join(F.broadcast(found.withColumnRenamed("position", "at")), "at", "left")  # one row a condition
    return [told.select("position", "name", "predicate", F.coalesce("n", F.lit(0)).alias("n"),
                        F.when(F.col("filled") > 0, 100.0 * (F.col("total") / F.col("filled"))).alias("rate"))]


# One aggregate call, optionally scaled, over one table with an optional condition.
_ONE_AGGREGATE = re.compile(
    r"select\s+(?P<factor>[\d.]+\s*\*\s*)?(?P<call>(?:count|sum|avg|min|max)\s*\([^()]*\))"
    r"\s+from\s+[\"`]?(?P<table>\w+)[\"`]?(?:\s+where\s+(?P<condition>.+))?", re.IGNORECASE | re.DOTALL)


def _shared_scan_form(sql: str, table: Binding) -> str | None:
    """The statement as one filtered aggregate expression, None when it needs a plan of its own."""
    match = _ONE_AGGREGATE.fullmatch(body_of(sql))
    if not match or match["table"].lower() != table.name.lower():
        return None
    condition = match["condition"] or "true"
    if re.search(r"\b(?:select|over)\b", condition, re.IGNORECASE):
        return None
    if re.search(r"\bdistinct\b", match["call"], re.IGNORECASE):
        return None  # several of them would multiply the rows of all that share the scan
    text = f"{match['factor'] or ''}{match['call']} FILTER (WHERE (\n{condition}\n))"
    try:
        table.empty.agg(F.expr(text))
    except STATEMENT_FAULTS:
        return None
    return text


def question_truth(table: Binding, statements: Mapping[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    """For each named scalar statement: its value as a double and rounded to two decimals.

    Statements that are one aggregate over the table share a scan as filtered aggregates;
    others keep a plan of their own and count with the first value of their first row, NULL
    without any. A statement that fails analysis raises.
    """
    items = list(statements.items()) if isinstance(statements, Mapping) else list(statements)
    parts, shared = [], []
    with session_settings(table.frame.sparkSession, GATE_SETTINGS):
        for position, (name, sql) in enumerate(items):
            judged(sql, table)
            text = _shared_scan_form(sql, table)
            row = [F.lit(position).alias("position"), F.lit(name).alias("name"), F.lit(sql).alias("statement")]
            if text is not None:
                shared.append((F.expr(text).cast("double").alias(f"v{position}"), row, position))
            else:
                answer = table.run.sql(body_of(sql))
                first = answer.toDF(*[f"v{i}" for i in range(len(answer.columns))]).limit(1)
                parts.append(first.agg(F.max(F.col("v0").cast("double")).alias("value")).select(*row, "value"))
        for group in scan_groups([items[position][1] for _, _, position in shared], PER_SCAN, CHARACTERS_PER_SCAN):
            batch = [shared[i] for i in group]
            rows = [F.struct(*row, F.col(f"v{position}").alias("value")) for _, row, position in batch]
            wide = table.frame.agg(*[value for value, _, _ in batch])
            parts.append(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return _union(parts).withColumn("value_2", round_exact(F.col("value"), 2))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def as_list(value: Column, listed: bool = False) -> Column:
    """A single text as a list of one, a list (``listed``) as it is; NULL as the empty list."""
    return F.coalesce(value if listed else F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))


def flag(value: Column) -> Column:
    """Missing flags are false."""
    return F.coalesce(value, F.lit(False))


def sample_id(dataset: Column, intent: Column, variant: Column) -> Column:
    return F.concat_ws(":", dataset, intent, variant.cast("string"))


def target_json(rows: Column, rates: Column, values: Column) -> Column:
    return F.to_json(F.struct(rows.alias("rows"), rates.alias("rates"), values.alias("values")))


def specs_table(spark: SparkSession, dataset: str, specs: Iterable[Mapping]) -> DataFrame:
    """Intent specifications as a table; one text or a list of texts is accepted as truth."""
    rows = []
    for spec in specs:
        truth = spec.get("truth_sql")
        alternatives = [truth] if isinstance(truth, str) else list(truth or [])
        rows.append((dataset, spec["intent"], spec["family"], alternatives, list(spec["phrasings"]),
                     spec.get("trap"), spec.get("rate")))
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def alternatives(specs: DataFrame, family: str) -> DataFrame:
    """One row per accepted alternative of the intents of a family, with its position."""
    return specs.where(F.col("family") == family).select(
        "dataset", "intent", F.posexplode("truth_sql").alias("alternative", "truth"))


def expand_samples(specs: DataFrame, filters: DataFrame, questions: DataFrame) -> DataFrame:
    """One sample per phrasing with the truth of its intent.

    ``filters`` holds (dataset, intent, alternative, n, rate_1), ``questions`` (dataset, intent,
    alternative, value_2). Truth lists are as long as an intent has alternatives.
    """
    def packed(truth: DataFrame, *columns: str) -> DataFrame:
        ordered = truth.groupBy("dataset", "intent").agg(
            F.sort_array(F.collect_list(F.struct("alternative", *columns))).alias("t"))
        return ordered.select("dataset", "intent", *[F.col(f"t.{c}").alias(c) for c in columns])

    def empty(kind: str) -> Column:
        return F.array().cast(f"array<{kind}>")

    joined = (specs.join(packed(filters, "n", "rate_1"), ["dataset", "intent"], "left")
              .join(packed(questions, "value_2"), ["dataset", "intent"], "left")
              .select("dataset", "intent", "family", "truth_sql",
                      flag(F.col("trap")).alias("trap"), flag(F.col("rate")).alias("rate"),
                      expected_tools(F.col("family")).alias("expected_tools"),
                      F.coalesce("n", empty("bigint")).alias("truth_rows"),
                      F.coalesce("rate_1", empty("double")).alias("truth_rates"),
                      F.coalesce("value_2", empty("double")).alias("truth_values"),
                      F.posexplode("phrasings").alias("variant", "input")))
    return joined.select(
        sample_id(F.col("dataset"), F.col("intent"), F.col("variant")).alias("id"), "input",
        target_json(F.col("truth_rows"), F.col("truth_rates"), F.col("truth_values")).alias("target"),
        F.struct("dataset", "intent", "family", "variant", "trap", "rate", "expected_tools", "truth_sql",
                 "truth_rows", "truth_rates", "truth_values").alias("metadata"))


def build_samples(table: Binding, specs: Iterable[Mapping], metric: str | None = None) -> DataFrame:
    """Samples of one analysed table from its intent specifications."""
    spark = table.frame.sparkSession
    specs = list(specs)
    metric = metric or fv.METRIC_COLUMN[table.name]
    by_family: dict[str, list[tuple[str, str]]] = {"filter": [], "question": []}
    keys: dict[str, list[tuple[str, int]]] = {"filter": [], "question": []}
    for spec in specs:
        truth = spec.get("truth_sql")
        texts = [truth] if isinstance(truth, str) else list(truth or [])
        for i, text in enumerate(texts if spec["family"] in by_family else []):
            by_family[spec["family"]].append((f"{spec['intent']}:{i}", text))
            keys[spec["family"]].append((spec["intent"], i))

    def keyed(truth: DataFrame, family: str) -> DataFrame:
        names = F.array(*[F.struct(F.lit(intent).alias("intent"), F.lit(i).alias("alternative"))
                          for intent, i in keys[family]])
        return truth.withColumn("k", F.get(names, F.col("position"))).select(
            F.lit(table.name).alias("dataset"), "k.intent", "k.alternative", "*")

    filters = keyed(filter_truth(table.frame, by_family["filter"], metric), "filter") if by_family["filter"] \
        else spark.createDataFrame([], "dataset string, intent string, alternative int, n bigint, rate_1 double")
    questions = keyed(question_truth(table, by_family["question"]), "question") if by_family["question"] \
        else spark.createDataFrame([], "dataset string, intent string, alternative int, value_2 double")
    return expand_samples(specs_table(spark, table.name, specs), filters, questions)


def family_counts(samples: DataFrame) -> DataFrame:
    """Number of samples per dataset and family."""
    return samples.groupBy("metadata.dataset", "metadata.family").agg(F.count(F.lit(1)).alias("samples"))
