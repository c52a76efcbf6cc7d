"""Truth values and samples, with the published numbers of the crashes table."""

from __future__ import annotations

import json

import pytest

from tablegauge import corpus, fixed_values as fv
from tablegauge.operators.statements import bind
from tablegauge.plans import truth
from tablegauge.sources import samples as sample_files


def test_filter_truth(crash_table):
    rows = {r.name: r for r in truth.filter_truth(crash_table.frame, {
        "zorgon": "planet = 'Zorgon'", "pilots": "crew_role = 'pilot'", "upper": "planet = 'ZORGON'"}, "survived_crash").collect()}
    assert (rows["zorgon"].n, rows["zorgon"].rate_1) == (30, 60.0)
    assert (rows["pilots"].n, rows["pilots"].rate_1) == (43, 93.0)
    assert (rows["upper"].n, rows["upper"].rate, rows["upper"].empty_selection) == (0, None, True)


def test_many_predicates_agree_with_single_ones(crash_table):
    predicates = {f"p{i}": f"age < {i} and planet <> 'Xylpha'" for i in range(18, 68)}
    rows = {r.name: r.n for r in truth.filter_truth(crash_table.frame, predicates, "survived_crash").collect()}
    people = [(r.age, r.planet) for r in crash_table.frame.collect()]
    assert rows == {f"p{i}": sum(a < i and p != "Xylpha" for a, p in people) for i in range(18, 68)}


def test_question_truth(crash_table):
    rows = {r.name: r.value_2 for r in truth.question_truth(crash_table, {
        "count": "SELECT count(*) FROM crashes WHERE planet = 'Brimtak' AND survived_crash = 1",
        "rate": "SELECT 100.0 * avg(survived_crash) FROM crashes WHERE crew_role = 'medic';",
        "overall": "SELECT 100.0 * avg(survived_crash) FROM crashes", "max": "SELECT max(age) FROM crashes",
        "first_row": "SELECT age, planet FROM crashes ORDER BY age DESC", "no_row": "SELECT age FROM crashes WHERE age > 1000",
        "own_plan": "SELECT max(n) FROM (SELECT planet, count(*) AS n FROM crashes GROUP BY planet) x"}).collect()}
    assert rows == {"count": 35.0, "rate": 31.58, "overall": 58.0, "max": 67.0, "own_plan": 50.0,
                    "first_row": 67.0, "no_row": None}


def test_one_scan_per_group_of_predicates(spark, tmp_path, crash_table):
    crash_table.frame.write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    plan = truth.filter_truth(frame, {f"p{i}": f"age < {i}" for i in range(30)}, "survived_crash")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert text.count("FileScan") == 1 and "ReadSchema: struct<survived_crash:int,age:int>" in text


def test_crash_samples(crash_table):
    built = {r.id: r for r in truth.build_samples(crash_table, corpus.INTENTS["crashes"]).collect()}
    assert len(built) == 11
    first = built["crashes:zorgon:0"]
    assert first.input == "Show only Zorgon passengers" and first.metadata.expected_tools == [fv.UPDATE_TOOL]
    assert json.loads(first.target) == {"rows": [30], "rates": [60.0], "values": []}
    assert json.loads(built["crashes:rate_medics:1"].target) == {"rows": [], "rates": [], "values": [31.58]}
    assert built["crashes:rate_medics:1"].metadata.rate is True and built["crashes:rate_medics:1"].metadata.trap is False
    assert built["crashes:reset:1"].metadata.truth_sql == [] and built["crashes:reset:1"].metadata.variant == 1


@pytest.fixture
def passengers(spark):
    rows = [(i % 2, i % 3 + 1, ["male", "female"][i % 2], None if i % 5 == 0 else float(i % 60), i / 3, "SCQ"[i % 3],
             ["man", "woman", "child"][i % 3], i % 4 == 0) for i in range(300)]
    return bind(spark.createDataFrame(rows, "survived int, pclass int, sex string, age double, fare double, embarked string, "
                                            "who string, alone boolean"), "titanic")


def test_passenger_corpus(passengers):
    built = truth.build_samples(passengers, corpus.INTENTS["titanic"]).cache()
    assert {(r.family, r.samples) for r in truth.family_counts(built).collect()} == {
        ("filter", 34), ("question", 16), ("reset", 4), ("out_of_scope", 4)}
    people = passengers.frame.collect()
    children = built.where("id = 'titanic:children:0'").first()
    assert children.metadata.trap is True
    assert children.metadata.truth_rows == [sum(p.who == "child" for p in people), sum(p.age is not None and p.age < 16 for p in people)]
    fare = built.where("id = 'titanic:avg_fare_first:0'").first().metadata.truth_values[0]
    first = [p.fare for p in people if p.pclass == 1]
    assert fare == pytest.approx(round(sum(first) / len(first), 2))
    inputs = {s for table in corpus.INTENTS.values() for spec in table for s in spec["phrasings"]}
    assert len(inputs) == 67


def test_column_meanings_and_vocabulary(passengers):
    from tablegauge.operators import dashboard as dash

    described = dash.with_meanings(passengers.frame, {"fare": "what was paid", "pclass": "how comfortable"})
    assert {r.column_name: r.meaning for r in dash.dictionary(described).collect() if r.meaning} == {
        "fare": "what was paid", "pclass": "how comfortable"}
    terms = {"cheap": "fare < 20", "upstairs": "pclass = 1", "solo women": "alone AND sex = 'female'", "long names": "length(who) > 4"}
    rows = {r.name: r.n for r in truth.filter_truth(described, terms, "survived").collect()}
    people = passengers.frame.collect()
    assert rows == {"cheap": sum(p.fare < 20 for p in people), "upstairs": sum(p.pclass == 1 for p in people),
                    "solo women": sum(p.alone and p.sex == "female" for p in people), "long names": sum(len(p.who) > 4 for p in people)}


def test_session_settings(spark):
    from tablegauge import session

    assert session.build().conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_sample_files(spark, tmp_path, crash_table):
    built = truth.build_samples(crash_table, corpus.INTENTS["crashes"])
    sample_files.write_samples(built, str(tmp_path / "s"))
    assert (tmp_path / "s" / "dataset=crashes").is_dir()
    stored = sample_files.read_samples(spark, str(tmp_path / "s"))
    assert stored.count() == 11 and stored.where("get(truth.rows, 0) = get(metadata.truth_rows, 0)").count() == 5
    assert {r.id: (r.input, r.target) for r in stored.collect()} == {r.id: (r.input, r.target) for r in built.collect()}
    assert sample_files.flattened(stored).columns[:4] == ["id", "input", "dataset", "intent"]
