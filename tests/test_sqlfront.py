import json
import re

import pytest
from conftest import rows

from weftline.plans import explain_json
from weftline.plans.catalog import JOB_COLUMNS, job_schema
from weftline.plans.sqlfront import SqlError, execute, oracle_text, parse
from weftline.sources.files import from_rows

DATA = {
    "title": ([(1, "Alpha", 1999), (2, "Beta", 2005), (3, None, 2010), (4, "Delta", None)], "id int, title string, production_year int"),
    "movie_link": ([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 1, 4)], "id int, movie_id int, linked_movie_id int"),
    "keyword": ([(7, "x"), (8, "y")], "id int, keyword string"),
    "movie_keyword": ([(1, 1, 7), (2, 2, 7), (3, 2, 8), (4, 4, 8)], "id int, movie_id int, keyword_id int"),
}


@pytest.fixture
def source(spark):
    def table(name):
        if name not in DATA:
            raise SqlError(f"no table {name}")
        return spark.createDataFrame(*DATA[name])

    for name in DATA:
        table(name).createOrReplaceTempView(name)
    return table


def run(text, source, **more):
    return execute(parse(text, lambda t: source(t).columns), source, **more)


SAME = [
    "SELECT t.title AS a, k.keyword AS b FROM title t, movie_keyword mk, keyword AS k WHERE t.id = mk.movie_id AND mk.keyword_id = k.id",
    "SELECT t1.title AS a, t2.title AS b FROM title t1, movie_link ml, title t2 WHERE t1.id = ml.movie_id AND ml.linked_movie_id = t2.id AND t1.production_year < t2.production_year",
    "SELECT MIN(t.title) AS a, MIN(mk.id) AS b FROM title t, movie_keyword mk WHERE t.id = mk.movie_id AND (t.title LIKE '%a' OR t.production_year BETWEEN 2000 AND 2010)",
    "SELECT title, keyword_id FROM title JOIN movie_keyword mk ON title.id = mk.movie_id WHERE NOT (keyword_id IN (7)) AND title IS NOT NULL",
    "SELECT title FROM title WHERE production_year IS NULL OR 2000 < production_year",
    "SELECT id FROM keyword",
    "SELECT t.id AS a, mk.id AS b FROM title t, movie_keyword mk WHERE t.id = mk.movie_id AND t.id = mk.id",
    "SELECT t.id AS a, ml.id AS b, mk.id AS c FROM title t, movie_link ml, movie_keyword mk WHERE t.id = ml.movie_id AND ml.movie_id = mk.movie_id AND t.id = mk.movie_id",
    "SELECT t.title AS a FROM title t, movie_keyword mk WHERE t.id = mk.movie_id AND (mk.keyword_id = 8 OR t.production_year = 1999);",
    "SELECT k.keyword AS a FROM keyword k WHERE k.keyword NOT LIKE 'x' AND k.id <> -3 AND k.id != 9 AND k.keyword NOT IN ('it''s')",
    "SELECT ml.id AS a FROM movie_link ml, title t WHERE ml.movie_id = t.id AND ml.linked_movie_id = t.id",
]


@pytest.mark.parametrize("text", SAME)
def test_same_as_spark_sql(spark, source, text):
    assert rows(run(text, source)) == rows(spark.sql(text.rstrip(";")))


def test_raw_mode_and_its_oracle(spark, source):
    text = SAME[2]
    query = parse(text, lambda t: source(t).columns)
    assert rows(execute(query, source, "raw")) == rows(spark.sql(oracle_text(query, text)))


@pytest.mark.parametrize(
    "text",
    ["SELECT x FROM title", "SELECT title FROM nope", "SELECT id FROM title, keyword WHERE title.id = keyword.id", "SELECT q.id FROM title t", "SELECT title FROM title t, title t WHERE t.id = t.id", "SELECT t.id FROM title t, keyword k", "SELECT MIN(t.id), t.title FROM title t", "SELECT f(id) FROM keyword", "SELECT id FROM keyword GROUP BY id", "SELECT id FROM keyword WHERE id LIKE", "SELECT id FROM keyword WHERE id ~ 3", "SELECT title.id FROM title a, title b WHERE a.id = b.id"],
)
def test_errors(source, text):
    with pytest.raises(SqlError):
        run(text, source)


def scan(alias=None, relation=None):
    return {"Node Type": "Seq Scan", **({"Alias": alias} if alias else {}), **({"Relation Name": relation} if relation else {})}


def hashed(probe, build):
    return {"Node Type": "Hash Join", "Plans": [probe, {"Node Type": "Hash", "Plans": [build]}]}


def test_imported_plan(spark, source, tmp_path):
    plan = {"Node Type": "Aggregate", "Plans": [{"Node Type": "Gather", "Plans": [hashed(hashed(scan("mk"), scan(relation="keyword")), scan("t"))]}]}
    path = tmp_path / "plans.json"
    path.write_text(json.dumps({"sql_directory": "q", "names": ["1a"], "plans": [{"Plan": plan}]}))
    directory, plans = explain_json.load(str(path))
    assert directory == "q"
    assert rows(explain_json.run(SAME[0], plans["1a"], source)) == rows(spark.sql(SAME[0]))


def test_cyclic_classes_keep_every_condition(spark, source):
    text = "SELECT t.id AS a, mk.id AS b, ml.id AS c FROM title t, movie_keyword mk, movie_link ml WHERE t.id = mk.movie_id AND mk.movie_id = ml.movie_id AND t.id = ml.movie_id AND mk.id = ml.id"
    assert rows(explain_json.run(text, hashed(hashed(scan("mk"), scan("t")), scan("ml")), source)) == rows(spark.sql(text))


@pytest.mark.parametrize("plan", [{"Node Type": "Nested Loop", "Plans": []}, {"Node Type": "Hash Join", "Plans": [scan("t"), scan("mk")]}, scan("zz"), {"Node Type": "Gather"}, hashed(scan("t"), scan("k"))])
def test_plans_that_do_not_fit(source, plan):
    with pytest.raises((explain_json.PlanImportError, SqlError)):
        explain_json.run(SAME[0], plan, source).collect()


def test_job_catalogue():
    assert len(JOB_COLUMNS) == 21
    assert sum(len(job_schema(t)) for t in JOB_COLUMNS) == 8 + 12 + 7 + 7 + 2 + 7 + 2 + 4 + 2 + 3 + 2 + 2 + 5 + 5 + 5 + 3 + 4 + 9 + 5 + 2 + 12
    assert job_schema("title")["production_year"].dataType.simpleString() == "int"


def test_comments_and_strings():
    columns = {"t": ["a", "b"]}.__getitem__
    assert parse("SELECT a FROM t -- end", columns).entities == {"t": "t"}
    assert parse("SELECT a -- t.b\nFROM t x --\nWHERE x.b = '-- not one'", columns).filters["x"].value == "-- not one"
    with pytest.raises(SqlError):
        parse("SELECT a FROM t WHERE b LIKE 5", columns)


def test_functions_of_several_columns(spark):
    df = spark.createDataFrame([(1, 2), (None, 3), (4, None)], "a int, b int")
    query = parse("SELECT COUNT(a, b) AS n, COUNT(a) FROM t", lambda _: df.columns)
    assert [tuple(r) for r in execute(query, lambda _: df).collect()] == [(1, 2)]
    raw = execute(query, lambda _: df, mode="raw")
    assert raw.count() == 3 and len(raw.columns) == 3
    with pytest.raises(SqlError):
        execute(parse("SELECT MIN(a, b) FROM t", lambda _: df.columns), lambda _: df)


def test_a_single_row_needs_no_join(spark, tmp_path):
    spark.range(50).selectExpr("id AS k", "id % 3 AS m").write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    frames = {"one": from_rows(spark, [(7, "x")], "k long, name string"), "nothing": from_rows(spark, [(None, "x")], "k long, name string"), "many": many}
    for one, want in (("one", [("x", 7)]), ("nothing", [])):
        for order in (f"{one} o, many m", f"many m, {one} o"):
            df = execute(parse(f"SELECT o.name, m.k FROM {order} WHERE o.k = m.k", lambda t: frames[t].columns), frames.__getitem__)
            assert [tuple(r) for r in df.collect()] == want
            assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_statistics_order_joins(spark):
    """With statistics of all tables, the selective join comes first, whatever FROM says."""
    made = {
        "cbo_a": spark.range(2000).selectExpr("id AS k", "id % 5 AS g"),
        "cbo_b": spark.range(2000).selectExpr("id AS k", "id % 5 AS g", "id AS one"),
        "cbo_c": spark.range(3).selectExpr("id AS one", "cast(id AS string) AS name"),
    }
    text = "SELECT a.k AS k, c.name AS name FROM cbo_a a, cbo_b b, cbo_c c WHERE a.g = b.g AND b.one = c.one"
    try:
        for name, df in made.items():
            df.write.mode("overwrite").saveAsTable(name)
        got = {}
        for known in (False, True):
            if known:
                for name in made:
                    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
            df = execute(parse(text, lambda t: spark.table(t).columns), spark.table)
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            depth = {t: line.index("Relation") for line in plan.splitlines() for t in re.findall(r"Relation spark_catalog.default.cbo_([abc])", line)}
            got[known] = {t for t, d in depth.items() if d > min(depth.values())}, rows(df)
        assert got[False][1] == got[True][1] and len(got[True][1]) == 1200
        assert got[False][0] == {"a", "b"} and got[True][0] == {"b", "c"}  # those joined first
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
