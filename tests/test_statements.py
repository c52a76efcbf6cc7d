"""Read-only gate, statement counts and their isolation, dashboard."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.operators import dashboard as dash
from tablegauge.operators import statements as st
from tablegauge.operators.dashboard import Dashboard


@pytest.fixture(scope="module")
def surroundings(spark, tmp_path_factory):
    """Views, a table and a function beside the bound table."""
    spark.range(3).createOrReplaceTempView("other_view")
    spark.range(3).createOrReplaceGlobalTempView("everybodys")
    spark.range(3).createOrReplaceGlobalTempView("crashes")
    spark.range(3).write.option("path", str(tmp_path_factory.mktemp("kept") / "table")).saveAsTable("kept_table")
    spark.udf.register("shout", lambda text: text.upper())
    assert spark.table("kept_table").count() == spark.table("global_temp.crashes").count() == 3
    yield
    spark.sql("DROP TABLE kept_table")


@pytest.mark.parametrize("sql", [
    "DROP TABLE crashes", "DELETE FROM crashes", "INSERT INTO crashes VALUES (1)", "CREATE TABLE t AS SELECT 1",
    "SET spark.sql.ansi.enabled=false", "EXPLAIN SELECT 1", "SELECT 1; SELECT 2", "SHOW TABLES", "", None, "   ;",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect` ('a', 'b')",
    "SELECT try_reflect/* */('java.lang.Math', 'abs', -1)", "SELECT java_method('java.lang.Math', 'abs', -1)",
    "SELECT * FROM crashes) q CROSS JOIN (SELECT 1", "SELECT * FROM crashes) q; DROP TABLE crashes --",
    "SELECT * FROM parquet.`/tmp`", "SELECT * FROM nope",
    "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', -1)", "SELECT * FROM other_view",
    r"SELECT '\' -- ' AS a, reflect('java.lang.Math', 'abs', -1)", r"SELECT '\' , ') q, (SELECT '1' AS z",
    "SELECT * FROM crashes WHERE age > (SELECT max(id) FROM other_view)",
    "SELECT * FROM crashes WHERE EXISTS (SELECT reflect('java.lang.Math', 'abs', age))",
    "SELECT shout(planet) FROM crashes", "SELECT current_user()", "SELECT input_file_name() FROM crashes", "SELECT version()",
    "SELECT * FROM crashes WHERE shout(planet) = 'ZORGON'", "SELECT current_catalog(), current_database()",
    "SELECT * FROM global_temp.everybodys", "SELECT * FROM kept_table", "SELECT * FROM global_temp.crashes",
])
def test_refused(crash_table, surroundings, sql):
    assert st.try_statement(sql, crash_table) is None


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT * FROM crashes WHERE planet = 'Zorgon'", 30), ("SELECT * FROM crashes WHERE planet = 'ZORGON'", 0),
    ('SELECT * FROM crashes WHERE "planet" = \'Zorgon\';', 30), ("SELECT * FROM CRASHES WHERE AGE < 20", 2),
    ("WITH a AS (SELECT * FROM crashes) SELECT * FROM a LIMIT 7", 7), ("VALUES (1), (2)", 2),
    ("SELECT planet, count(*) FROM crashes GROUP BY ALL", 3), ("SELECT * FROM crashes WHERE planet <> ')'", 100),
    ("SELECT age, age FROM crashes -- (", 100), ("SELECT '${env:HOME}' AS x", 1),
])
def test_accepted(crash_table, sql, rows):
    assert st.run_statement(sql, crash_table).count() == rows


def test_nothing_is_left_in_the_session(spark):
    before = {t.name for t in spark.catalog.listTables()} | {t.name for t in spark.catalog.listTables("global_temp")}
    table = st.bind(spark.range(5), "numbers")
    assert st.run_statement("SELECT * FROM numbers WHERE id > 2", table).count() == 2
    assert {t.name for t in spark.catalog.listTables()} | {t.name for t in spark.catalog.listTables("global_temp")} == before


def test_answers_mix_with_tables_of_the_caller(spark, crash_table):
    answer = st.run_statement("SELECT planet, count(*) AS n FROM crashes GROUP BY planet", crash_table)
    mine = spark.createDataFrame([("Zorgon", 1)], "planet string, m int")
    assert mine.join(answer, "planet").first().n == 30 and answer.join(mine, "planet").first().m == 1
    assert answer.select("planet").unionByName(mine.select("planet")).count() == 4


def test_settings_of_the_caller_hold(spark):
    with st.session_settings(spark, {"spark.sql.shuffle.partitions": "3"}):
        table = st.bind(spark.range(5), "numbers")
        assert table.gate.conf.get("spark.sql.shuffle.partitions") == table.run.conf.get("spark.sql.shuffle.partitions") == "3"


def test_order_survives_the_gate(crash_table):
    ages = [r.age for r in st.run_statement("SELECT age FROM crashes ORDER BY age DESC LIMIT 5", crash_table).collect()]
    assert ages == [67, 66, 65, 64, 63]


def test_gate_keeps_session_settings_and_views(spark, crash_table):
    spark.range(3).createOrReplaceTempView("crashes")
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", None)
    assert st.run_statement("SELECT * FROM crashes", crash_table).count() == 100
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", None) == before
    assert spark.table("crashes").count() == 3
    spark.catalog.dropTempView("crashes")


STATEMENTS = {
    "SELECT * FROM crashes WHERE planet = 'Zorgon'": 30, "SELECT * FROM crashes WHERE crew_role = 'pilot'": 43,
    "SELECT * FROM crashes WHERE 1 / (age - age) > 0": None, "SELECT * FROM crashes WHERE CAST(planet AS INT) > 1": None,
    "SELECT planet FROM crashes GROUP BY planet": 3, "SELECT * FROM nope": None, "DROP TABLE crashes": None,
    "SELECT * FROM crashes WHERE age IN (SELECT max(age) FROM crashes)": 1,
    "SELECT * FROM crashes WHERE age > 60 LIMIT 2": 2, "SELECT * FROM crashes WHERE age > 60 OR planet = 'Xylpha'": 27,
    "SELECT planet, 1 / (age - 20) FROM crashes": 100, "SELECT * FROM crashes WHERE age": None,
    "SELECT * FROM crashes WHERE (age > 60": None, "SELECT * FROM crashes WHERE age > 60) OR (age < 20": None,
    "SELECT * FROM crashes WHERE count(*) > 1": None, "SELECT * FROM crashes WHERE age > 60 AS x": None,
    "SELECT * FROM crashes WHERE age > 60 ORDER BY age": 7, "SELECT * FROM crashes WHERE explode(array(true))": None,
    "SELECT * FROM crashes WHERE reflect('java.lang.Math', 'abs', age) = 1": None, "SELECT * FROM crashes WHERE planet LIKE 'Z%'": 30,
    "select * from crashes where 'Zorgon' = planet": 30, "SELECT planet, count(*) FROM crashes GROUP BY planet": 3,
    "select PLANET , count( * ) from Crashes group by PLANET": 3, "SELECT * FROM crashes WHERE true -- all": 100,
    "SELECT * FROM crashes WHERE age > 1000": 0, "SELECT * FROM crashes WHERE planet = 'x' AND rand() < 2": 0,
}


@pytest.mark.parametrize("batch_size", [3, 64])
def test_statement_counts(spark, crash_table, batch_size):
    rows = [("crashes", s) for s in STATEMENTS for _ in range(2)] + [("crashes", ""), ("crashes", None)]
    distinct = st.distinct_statements(spark.createDataFrame(rows, "dataset string, statement string"))
    counted = st.count_statements(distinct, {"crashes": crash_table}, batch_size=batch_size).collect()
    assert {r.statement: r.n for r in counted} == STATEMENTS
    assert all(r.uses == 2 and (r.fault is None) == (r.n is not None) for r in counted)


def test_strict_counts_see_faults_in_the_projection(spark, crash_table):
    rows = spark.createDataFrame([("crashes", "SELECT planet, 1 / (age - 20) FROM crashes", 1)],
                                 "dataset string, statement string, uses bigint")
    assert st.count_statements(rows, {"crashes": crash_table}, strict=True).first().n is None


def test_one_count_for_one_meaning(spark, crash_table):
    """Spelling, spacing and the order of operands make no plan of their own."""
    same = ["SELECT planet FROM crashes WHERE age > 20 AND planet = 'Zorgon' GROUP BY planet",
            "select  Planet from CRASHES where 'Zorgon' = planet and age > 20 group by planet",
            "SELECT planet FROM crashes WHERE (planet = 'Zorgon') AND 20 < age GROUP BY planet"]
    other = "SELECT planet FROM crashes WHERE age > 21 AND planet = 'Zorgon' GROUP BY planet"
    outcomes = {}
    classes = st._classes(list(enumerate([*same, other])), crash_table, outcomes)
    assert sorted(c.members for c in classes) == [[0, 1, 2], [3]] and outcomes == {}
    rows = spark.createDataFrame([("crashes", s, 1) for s in [*same, other]], "dataset string, statement string, uses bigint")
    assert [r.n for r in st.count_statements(rows, {"crashes": crash_table}).collect()] == [1] * 4


def test_fingerprints(spark, crash_table):
    """Statements with the same rows in whatever order, and only those, have equal fingerprints."""
    answers = ["SELECT * FROM crashes WHERE planet = 'Zorgon'", "SELECT * FROM crashes WHERE NOT planet <> 'Zorgon'",
               "SELECT * FROM crashes WHERE planet LIKE 'Zor%'", "SELECT * FROM crashes WHERE planet = 'Zorgon' ORDER BY age",
               "SELECT * FROM crashes WHERE crew_role = 'pilot' AND age < 48", "SELECT * FROM crashes WHERE planet = 'none'",
               "SELECT * FROM crashes LIMIT 0", "SELECT age FROM crashes WHERE planet = 'Zorgon'", "SELECT * FROM crashes WHERE age = 'x'"]
    rows = spark.createDataFrame([("crashes", s, 1) for s in answers], "dataset string, statement string, uses bigint")
    found = {r.statement: (r.n, r.rows_a, r.rows_b) for r in
             st.count_statements(rows, {"crashes": crash_table}, fingerprints=True).collect()}
    told = [found[s] for s in answers]
    assert told[0] == told[1] == told[2] == told[3] != told[4] and told[5] == told[6] == (0, 0, 0) and told[8] == (None, None, None)
    assert told[7][0] == 30 and told[7] != told[0]
    frames = [st.run_statement(s, crash_table) for s in answers[:5]]
    assert [st.same_rows(frames[0], f).first().same for f in frames] == [t == told[0] for t in told[:5]]


def test_fingerprint_counts_missing_values_by_place(spark):
    tables = [spark.createDataFrame(rows, "a int, b int") for rows in (
        [(None, 5)], [(5, None)], [(5, 5)], [(None, 5), (None, 5)], [(None, 5), (5, None)], [(5, None), (None, 5)])]
    sums = [tuple(t.agg(*[F.sum(c) for c in st.fingerprint(t).values()]).first()) for t in tables]
    assert len(set(sums[:5])) == 5 and sums[4] == sums[5]


def test_lookup_of_hot_statements(spark):
    counts = spark.createDataFrame([("a", f"s{i}", 9000 if i == 0 else 1, i, None) for i in range(1500)],
                                   "dataset string, statement string, uses bigint, n bigint, fault string")
    runs = spark.range(9000).select("id", F.lit("a").alias("dataset"), F.when(F.col("id") % 3 > 0, "s0").otherwise(
        F.concat(F.lit("s"), (F.col("id") % 2000).cast("string"))).alias("sql"))
    joined = st.with_statement_counts(runs, counts, "dataset", "sql", spread_by=["id"])
    assert joined.columns == ["id", "dataset", "sql", "statement_rows"] and joined.count() == 9000
    number = F.substring("sql", 2, 9).cast("bigint")
    assert joined.where(~F.col("statement_rows").eqNullSafe(F.when(number < 1500, number))).count() == 0


def test_scan_groups_cover_everything_once():
    for n in (1, 31, 32, 33, 64, 65, 200):
        groups = st.scan_groups(["x" * 30] * n, 32, 1200)
        assert [i for g in groups for i in g] == list(range(n)) and max(map(len, groups)) <= 33


def test_same_rows(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,), (1,)], "x int")
    assert st.same_rows(a, b).first().same
    row = st.same_rows(a, b.distinct()).first()
    assert (row.missing, row.extra, row.same) == (0, 1, False)


def test_dashboard(crash_table):
    board = Dashboard(crash_table.frame, "crashes", "All crashes")
    assert board.view.count() == 100 and board.title() == "All crashes"
    assert board.filter("SELECT * FROM crashes WHERE planet = 'Zorgon'", "Zorgon").count() == 30
    assert board.title() == "Zorgon"
    assert board.scalar("SELECT count(*) FROM crashes WHERE planet = 'Brimtak' AND survived_crash = 1") == 35
    with pytest.raises(st.RefusedStatement):
        board.filter("")
    assert board.view.count() == 30
    assert board.reset().count() == 100 and board.title() == "All crashes"
    assert board.scalar("SELECT age FROM crashes WHERE age > 1000") is None
    shown = board.replay([(fv.UPDATE_TOOL, "not even SQL"), (fv.QUERY_TOOL, "SELECT 1"),
                          (fv.UPDATE_TOOL, "SELECT * FROM crashes WHERE crew_role = 'pilot'")])
    assert shown.count() == 43
    assert board.replay([(fv.UPDATE_TOOL, "x"), (fv.RESET_TOOL, None)]).count() == 100


def test_profile_and_dictionary(spark, crash_table):
    frame = dash.with_meanings(crash_table.frame, {"age": "years", "absent": "-"})
    rows = {r.column_name: r for r in dash.profile(frame, exact=True).collect()}
    assert (rows["age"].meaning, rows["age"].smallest, rows["age"].largest) == ("years", "18", "67")
    assert rows["planet"].distinct_values == 3 and rows["planet"].filled == 100
    values = {(r.column_name, r.value): r.n for r in dash.vocabulary_values(frame, limit=2).collect()}
    assert values == {("crew_role", "pilot"): 43, ("crew_role", "medic"): 57}
    assert {r.column_name: r.meaning for r in dash.dictionary(frame).collect()}["age"] == "years"
    wide = spark.createDataFrame([([1],)], "x array<int>")
    assert dash.profile(wide).first().largest == "[1]"
