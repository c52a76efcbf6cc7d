"""Running SQL text written by others: read-only gate, row counts, stricter comparisons.

A statement must be analysed on the driver, once per distinct text; everything that
touches rows runs as Spark jobs. Filters that compare columns with constants share a single scan,
however many they are.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from functools import cached_property, partial
from itertools import islice
from typing import NamedTuple

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    ParseException,
    SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.operators import predicates
from tablegauge.operators.lookup import hot_hashes, salted_lookup
from tablegauge.operators.predicates import Condition
from tablegauge.workdir import new_path, session_settings, small_table, written

# Identifiers in double quotes as in standard SQL; no file paths as tables; no ${...} expansion.
GATE_SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.variable.substitute": "false",
}

# Faults of the statement itself. Anything else (lost executors, full disks) is raised
# to the caller, never taken for a wrong statement.
STATEMENT_FAULTS = (
    AnalysisException, ParseException, ArithmeticException, NumberFormatException,
    ArrayIndexOutOfBoundsException, DateTimeException, SparkRuntimeException, IllegalArgumentException,
)

JOBS_AT_ONCE = 4
PLANS_AT_ONCE = 32

COUNT_SCHEMA = ("dataset string, statement string, uses bigint, n bigint, rows_a decimal(38,0), rows_b decimal(38,0), "
                "fault string")

# What an analysed plan may not hold, by class: calls into the host, functions of the session, what tells of the host.
_REFUSED_CALLS = {
    "CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDTF", "PythonUDAF", "ScalaUDF", "ScalaUDAF", "ScalaAggregator",
    "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "HiveUDAFFunction", "InputFileName", "InputFileBlockStart",
    "InputFileBlockLength", "CurrentUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion",
}
_OWN_ROWS = {"OneRowRelation", "LocalRelation", "Range", "ResolvedInlineTable", "CTERelationRef"}
_SIMPLE_FILTER = re.compile(
    r"\s*select\s+\*\s+from\s+[\"`]?(?P<table>\w+)[\"`]?\s+where\s+(?P<condition>.+)", re.IGNORECASE | re.DOTALL)


class RefusedStatement(ValueError):
    """The text is not one read-only query."""


class Binding:
    """A table under the name statements use for it.

    Statements live in sessions of their own, which know this one name and none of the caller's views and functions. One has
    an empty table with the same columns behind the name: there a statement is judged, on a plan as small as its text. The
    other has the table itself, and is made when the first statement runs.
    """

    def __init__(self, frame: DataFrame, name: str) -> None:
        self.name, self.frame = name, frame
        self.empty = empty_like(frame)
        self.empty.createOrReplaceTempView(name)
        self.gate = self.empty.sparkSession

    @cached_property
    def run(self) -> SparkSession:
        session, passed = _separate(self.frame.sparkSession), f"passed_{uuid.uuid4().hex}"
        self.frame.createGlobalTempView(passed)
        try:
            session.table(f"global_temp.{passed}").createOrReplaceTempView(self.name)
        finally:
            self.frame.sparkSession.catalog.dropGlobalTempView(passed)
        return session


def _separate(spark: SparkSession) -> SparkSession:
    """A session with the settings of another and those of the gate, without its views and functions."""
    session = spark.newSession()
    for key, value in ({**spark.conf.getAll, **GATE_SETTINGS}).items():
        if session.conf.get(key, None) != value:
            session.conf.set(key, value)
    return session


def empty_like(frame: DataFrame) -> DataFrame:
    """A table without rows, with the same columns, in a session with the settings of the gate."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in frame.schema.fields]
    return _separate(frame.sparkSession).range(0).select(*columns)


def bind(frame: DataFrame, name: str) -> Binding:
    """Make a table known to statements without touching a view of that name in the session."""
    return Binding(frame, name)


def body_of(sql: str | None) -> str:
    """Statement text without surrounding space and closing semicolons."""
    return (sql or "").strip().rstrip("; \t\r\n")


def judged(sql: str | None, table: Binding) -> DataFrame:
    """A statement as analysed over the empty table; faults in it raise, and so does what no statement may do.

    Spark's own parser takes no command and no second statement.
    """
    body = body_of(sql)
    if not body:
        raise RefusedStatement("empty statement")
    table.gate._jsparkSession.sessionState().sqlParser().parseQuery(body)
    answer = table.gate.sql(body)
    _check_plan(answer, table.name)
    return answer


def run_statement(sql: str | None, table: Binding) -> DataFrame:
    """Analyse a gated statement; faults in it raise, rows stay lazy."""
    judged(sql, table)
    return table.run.sql(body_of(sql))


def _nodes(value) -> Iterator[dict]:
    """All operators and expressions in the JSON form of a plan."""
    if isinstance(value, dict):
        if isinstance(value.get("class"), str):
            yield value
        value = list(value.values())
    if isinstance(value, list):
        for part in value:
            yield from _nodes(part)


def _kind(node: dict) -> str:
    return node["class"].rsplit(".", 1)[-1]


def _check_plan(answer: DataFrame, name: str) -> None:
    """Refuse calls into the host and rows of other tables, by the analysed plan and whatever its text looks like.

    The bound name is a range without rows, so any other relation is a foreign one.
    """
    plan = answer._jdf.queryExecution().analyzed()
    inner, plans = plan.subqueriesAll().iterator(), [plan]
    while inner.hasNext():
        plans.append(inner.next())
    for operators in (json.loads(plan.toJSON()) for plan in plans):
        for node in _nodes(operators):
            if _kind(node) in _REFUSED_CALLS:
                raise RefusedStatement("calls into the host and functions of the session are not allowed")
            if _kind(node) == "View" and node["desc"]["identifier"] | {"product-class": ""} != {"product-class": "", "table": name}:
                raise RefusedStatement("only the bound table can be read")
        if any(node["num-children"] == 0 and _kind(node) not in _OWN_ROWS for node in operators):
            raise RefusedStatement("only the bound table can be read")


def try_statement(sql: str | None, table: Binding) -> DataFrame | None:
    """Like ``run_statement``, with None for a statement that cannot be analysed."""
    try:
        return run_statement(sql, table)
    except (RefusedStatement, *STATEMENT_FAULTS):
        return None


def fingerprint(frame: DataFrame) -> dict[str, Column]:
    """Measures whose sums, beside the number of rows, tell whether two tables hold the same rows in whatever order.

    Two hashes of a row, as numbers that sums of any length hold. Equal tables have equal sums; different ones have with a
    chance of one in 2**128. Missing values count by their place.
    """
    columns = [F.col(f"`{name}`") if frame.columns.count(name) == 1 else frame[i] for i, name in enumerate(frame.columns)]
    missing = F.array(*[column.isNull() for column in columns])
    return {"rows_a": F.xxhash64(*columns, missing).cast("decimal(20,0)"),
            "rows_b": F.xxhash64(missing, *columns).cast("decimal(20,0)")}


MEASURES = ("rows_a", "rows_b")


class _Filter(NamedTuple):
    """A statement that is nothing but a condition on the bound table."""

    text: str
    condition: Condition | None  # set when it only compares columns with constants


def _filters(texts: list[str], table: Binding) -> list[_Filter | None]:
    """Conditions of plain filters, None for statements that must be analysed on their own.

    All are analysed at once; one that can't be is found by halves.
    """
    if not texts:
        return []
    try:
        found = predicates.analysed(table.empty, texts)
    except (ValueError, *STATEMENT_FAULTS):
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _filters(texts[:half], table) + _filters(texts[half:], table)
    filters = [None if any(node.kind in _REFUSED_CALLS for node in tree.walk())
               else _Filter(text, predicates.indexed(text, tree)) for text, tree in zip(texts, found)]
    fit = _fit_for_aggregates([f.text for f in filters if f and not f.condition], table)
    return [f if f is None or f.condition or f.text in fit else None for f in filters]


def _fit_for_aggregates(texts: list[str], table: Binding) -> set[str]:
    """Conditions that may filter an aggregate; those on random values, for example, may not."""
    try:
        table.empty.agg(*[F.count_if(F.lit(True)), *[F.expr(f"count(*) FILTER (WHERE (\n{text}\n))") for text in texts]])
    except STATEMENT_FAULTS:
        half = len(texts) // 2
        return _fit_for_aggregates(texts[:half], table) | _fit_for_aggregates(texts[half:], table) if half else set()
    return set(texts)


def _plain_condition(sql: str, table: Binding) -> str | None:
    """Text behind WHERE of ``SELECT * FROM <table> WHERE <condition>``."""
    match = _SIMPLE_FILTER.fullmatch(body_of(sql))
    if not match or match["table"].lower() != table.name.lower():
        return None
    return None if re.search(r"\b(?:select|over)\b", match["condition"], re.IGNORECASE) else match["condition"]


def scan_groups(texts: Sequence[str], size: int, characters: int) -> list[range]:
    """Positions of conditions that should share a scan, in even groups.

    Code generated for one scan must stay below the size the JVM compiles; past it a scan is
    ten times slower, so a second scan is cheaper. Text length stands in for code size.
    """
    groups = max(1, math.ceil(len(texts) / size), math.ceil(sum(map(len, texts)) / characters))
    bounds = [round(i * len(texts) / groups) for i in range(groups + 1)]
    return [range(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


class _Class(NamedTuple):
    """Statements with one analysed plan: a representative, and all their positions."""

    sql: str
    plan: DataFrame
    members: list[int]


def _classes(statements: list[tuple[int, str]], table: Binding, outcomes: dict[int, Outcome]) -> list[_Class]:
    """Statements that mean the same, once; faults go to the outcomes.

    Spark's canonical plans settle spelling, spacing, and the order of operands; the hash finds plans that may be the same.
    """
    by_hash: dict[int, list[_Class]] = {}
    for position, sql in statements:
        try:
            plan = judged(sql, table)
        except (RefusedStatement, *STATEMENT_FAULTS) as fault:
            outcomes[position] = Outcome(fault=type(fault).__name__)
            continue
        alike = by_hash.setdefault(plan.semanticHash(), [])
        same = next((c for c in alike if c.plan.sameSemantics(plan)), None)
        if same:
            same.members.append(position)
        else:
            alike.append(_Class(sql, plan, [position]))
    return [c for alike in by_hash.values() for c in alike]


class Outcome(NamedTuple):
    """Row count of a statement with the sums of its fingerprint, or its fault."""

    n: int | None = None
    sums: tuple = (None, None)
    fault: str | None = None


def _count_indexed(filters: list[_Filter], table: Binding, measured: bool) -> list[Outcome]:
    """All comparisons with constants in one scan; what they select not at all has no row there."""
    none = (Decimal(0), Decimal(0)) if measured else (None, None)
    found = [Outcome(0, none)] * len(filters)
    frame = table.frame
    for part in predicates.matches(frame, [f.condition for f in filters], fingerprint(frame) if measured else {}):
        for row in part.collect():  # one row a condition
            found[row.position] = Outcome(row.n, (row.rows_a, row.rows_b) if measured else (None, None))
    return found


def _count_filters(filters: list[_Filter], table: Binding, measured: bool) -> list[Outcome]:
    """Other conditions as filtered aggregates of a shared scan."""
    frame = table.frame
    sums = fingerprint(frame) if measured else {}
    source = frame.select("*", *[column.alias(f"_{name}") for name, column in sums.items()])
    row = source.agg(*[column for f in filters for column in (
        F.expr(f"count(*) FILTER (WHERE (\n{f.text}\n))"),
        *[F.coalesce(F.expr(f"sum(_{name}) FILTER (WHERE (\n{f.text}\n))"), F.lit(0)) for name in sums])]).first()
    width = 1 + len(sums)
    return [Outcome(row[i], tuple(row[i + 1:i + width]) if measured else (None, None)) for i in range(0, len(row), width)]


def _count_plans(classes: list[_Class], table: Binding, measured: bool) -> list[Outcome]:
    """One aggregate over each plan, all in one job."""
    union = None
    for i, one in enumerate(classes):
        rows = table.run.sql(body_of(one.sql))
        named = rows.toDF(*[f"_{k}" for k in range(len(rows.columns))])
        sums = [F.coalesce(F.sum(column), F.lit(0)).alias(name) for name, column in fingerprint(named).items()] if measured else []
        part = named.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n"), *sums)
        union = part if union is None else union.unionByName(part)
    counted = {row.i: Outcome(row.n, (row.rows_a, row.rows_b) if measured else (None, None)) for row in union.collect()}
    return [counted[i] for i in range(len(classes))]


def _isolated(count: Callable[[list], list[Outcome]], items: list, text: Callable[[object], str]) -> list[Outcome]:
    """Outcomes of a job; when it fails, divide it until the faulty statements stand alone."""
    try:
        return count(items)
    except STATEMENT_FAULTS as fault:
        if len(items) == 1:
            return [Outcome(fault=type(fault).__name__)]
        results: dict[int, Outcome] = {}
        for part in _suspects([text(item) for item in items], fault):
            results.update(zip(part, _isolated(count, [items[i] for i in part], text), strict=True))
        return [results[i] for i in range(len(items))]


def _suspects(texts: list[str], fault) -> tuple[list[int], list[int]]:
    """Positions of the statements a fault points at and of the others; halves if it points nowhere."""
    fragments = {context.fragment() for context in fault.getQueryContext() or [] if context.fragment()}
    accused = [i for i, text in enumerate(texts) if any(f in text for f in fragments)]
    if not accused or len(accused) == len(texts):
        accused = list(range(len(texts) // 2))
    return accused, [i for i in range(len(texts)) if i not in accused]


def _read_in_full(classes: list[_Class], table: Binding, outcomes: dict[int, Outcome]) -> list[_Class]:
    """Classes whose rows can all be made; counting prunes the projection and passes over faults that sit only there."""
    sound = []
    for one in classes:
        try:
            table.run.sql(body_of(one.sql)).write.format("noop").mode("overwrite").save()
            sound.append(one)
        except STATEMENT_FAULTS as fault:
            outcomes.update({position: Outcome(fault=type(fault).__name__) for position in one.members})
    return sound


def _counted(statements: list[tuple[int, str]], table: Binding, strict: bool, measured: bool) -> dict[int, Outcome]:
    """Outcomes of statements on one table by their positions."""
    outcomes: dict[int, Outcome] = {}
    texts = [(position, sql, _plain_condition(sql, table)) for position, sql in statements]
    plain = [(position, sql, text) for position, sql, text in texts if text is not None]
    filters = dict(zip([position for position, _, _ in plain], _filters([text for _, _, text in plain], table)))
    index = [position for position, found in filters.items() if found and found.condition]
    others = [position for position, found in filters.items() if found and not found.condition]
    classes = _classes([(position, sql) for position, sql, _ in texts if filters.get(position) is None], table, outcomes)
    if strict:
        classes = _read_in_full(classes, table, outcomes)
    jobs: list[tuple[list[list[int]], Callable[[], list[Outcome]]]] = []
    if index:
        jobs.append(([[i] for i in index], partial(_count_indexed, [filters[i] for i in index], table, measured)))
    for group in scan_groups([filters[i].text for i in others], 32, 1200) if others else []:
        some = [others[i] for i in group]
        jobs.append(([[i] for i in some], partial(_isolated, partial(_count_filters, table=table, measured=measured),
                                                  [filters[i] for i in some], lambda f: f.text)))
    for at in range(0, len(classes), PLANS_AT_ONCE):
        some = classes[at:at + PLANS_AT_ONCE]
        jobs.append(([c.members for c in some], partial(_isolated, partial(_count_plans, table=table, measured=measured), some,
                                                        lambda c: c.sql)))
    with session_settings(table.frame.sparkSession, GATE_SETTINGS), ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        for members, found in zip([m for m, _ in jobs], pool.map(lambda job: job[1](), jobs)):
            for positions, outcome in zip(members, found, strict=True):
                outcomes.update({position: outcome for position in positions})
    return outcomes


def _batches(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def normalized(statement: Column) -> Column:
    """Statement text without surrounding space and closing semicolons, so that such variants run once."""
    return F.regexp_replace(statement, r"^\s+|[;\s]+\z", "")


def distinct_statements(requests: DataFrame, dataset: str = "dataset", statement: str = "statement") -> DataFrame:
    """Each (dataset, statement) once with its number of uses; empty statements are left out."""
    return (requests.select(F.col(dataset).alias("dataset"), normalized(F.col(statement)).alias("statement"))
            .where(F.coalesce(F.col("statement") != "", F.lit(False)))
            .groupBy("dataset", "statement").agg(F.count(F.lit(1)).alias("uses")))


def count_statements(statements: DataFrame, tables: dict[str, Binding], *, batch_size: int = 512,
                     strict: bool = False, fingerprints: bool = False) -> DataFrame:
    """Row count of every distinct statement, NULL with the fault for those that fail.

    Statements pass the driver in batches, because that is where SQL is analysed; the outcome of a batch is appended to a
    table in the shared folder. Neither all statements nor all outcomes are ever held at once. Of a batch, all filters that
    compare columns with constants share one scan, other filters share scans, and statements with the same meaning are
    counted once. With ``fingerprints`` the same jobs also tell the sums of ``fingerprint`` over the rows of each statement.
    """
    spark = statements.sparkSession
    path, told = new_path(spark, "statement-counts"), False
    # Written first: an iterator over a shuffle runs a job for each of its partitions, however few rows they have.
    for batch in _batches(written(statements, "statements").toLocalIterator(), batch_size):
        by_table: dict[str, list[tuple[int, str]]] = {}
        for position, row in enumerate(batch):
            by_table.setdefault(row.dataset, []).append((position, row.statement))
        found: dict[int, Outcome] = {}
        for dataset, asked in by_table.items():
            if dataset in tables:
                found.update(_counted(asked, tables[dataset], strict, fingerprints))
            else:
                found.update({position: Outcome(fault="unknown dataset") for position, _ in asked})
        rows = [{"dataset": row.dataset, "statement": row.statement, "uses": row.uses, "n": found[i].n, "rows_a": found[i].sums[0],
                 "rows_b": found[i].sums[1], "fault": found[i].fault} for i, row in enumerate(batch)]
        small_table(spark, rows, COUNT_SCHEMA).write.mode("append").parquet(path)
        told = True
    counted = spark.read.schema(COUNT_SCHEMA).parquet(path) if told else spark.createDataFrame([], COUNT_SCHEMA)
    return counted if fingerprints else counted.drop(*MEASURES)


def with_statement_counts(requests: DataFrame, counts: DataFrame, dataset: str = "dataset",
                          statement: str = "statement", *, spread_by: Sequence[str]) -> DataFrame:
    """Add the row count of each request's statement as ``statement_rows``.

    One popular statement may make up a third of all requests, so hot statements are spread
    over the values of ``spread_by``, for example the id of a request.
    """
    right = counts.select(F.col("dataset").alias("key_dataset"), F.col("statement").alias("key_statement"),
                          F.col("n").alias("statement_rows"))
    hot = hot_hashes(counts, ["dataset", "statement"])
    keyed = requests.withColumn("_normalized", F.nullif(normalized(F.col(statement)), F.lit("")))
    keys = [(dataset, "key_dataset"), ("_normalized", "key_statement")]
    return salted_lookup(keyed, right, keys, hot, spread_by).drop("_normalized")


def same_answers(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``same`` to pairs of statements (dataset, statement; truth_dataset, truth): have both the same rows in any order?

    Compared are the fingerprints that ``count_statements`` found; a faulty statement is the same as none. Where a chance of
    one in 2**128 is too much, ``same_rows`` tells it for the pairs that are equal by this.
    """
    told = pairs
    for side, dataset, statement in (("left", "dataset", "statement"), ("right", "truth_dataset", "truth")):
        found = counts.select(F.col("dataset").alias("_dataset"), F.col("statement").alias("_statement"),
                              F.struct("n", *MEASURES).alias(side))
        told = told.join(found, (F.col(dataset) == F.col("_dataset")) & (F.col(statement) == F.col("_statement")), "left") \
            .drop("_dataset", "_statement")
    return told.withColumn("same", F.coalesce((F.col("left") == F.col("right")) & F.col("left.n").isNotNull(), F.lit(False))) \
        .drop("left", "right")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do two results hold the same rows, repeats included, whatever their order?"""
    names = [f"_{i}" for i in range(len(left.columns))]
    sides = left.toDF(*names).withColumn("_d", F.lit(1)).union(right.toDF(*names).withColumn("_d", F.lit(-1)))
    surplus = sides.groupBy(*names).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    counted = surplus.agg(F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("missing"),
                          F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).alias("extra"))
    return counted.withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0))
