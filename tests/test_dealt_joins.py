"""Joins whose keys both sides repeat: the whole product, dealt over many tasks."""

import datetime
import os
from decimal import Decimal

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import joins
from weftline.plans.catalog import parquet_tables
from weftline.plans.compiler import compile_plan
from weftline.plans.nodes import Plan
from weftline.plans.queries import ORACLE_SQL, QUERIES
from weftline.plans.sqlfront import default_tree, parse, to_plan

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def small(monkeypatch):
    """The bounds, small enough for small tables."""
    for name, value in (("TASK_ROWS", 40), ("CELL_SIDE", 8), ("BUILD_ROWS", 32), ("COPIED_ROWS", 500)):
        monkeypatch.setattr(joins, name, value)


def product(left, right, keys=((0, 0),), build_left=None):
    plan = Plan()
    a, b = plan.scan(plan.add_input(left)), plan.scan(plan.add_input(right))
    plan.join(a, b, list(keys), build_left=build_left, many=True)
    return compile_plan(plan)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["join_dup_keys", "join_null_keys", "join_transitive", "cached_subplan", "join_self"])
def test_queries_deal_their_product(spark, small, monkeypatch, name):
    monkeypatch.setattr(joins, "TASK_ROWS", 8)
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    monkeypatch.setattr(joins, "TASK_ROWS", len(want) // 8)
    df = QUERIES[name](spark, DATA).select(*names)
    assert rows(df) == sorted(want)
    assert "_cell" in df._jdf.queryExecution().analyzed().toString() and most_in_a_task(df) < len(want) / 2


@pytest.mark.parametrize("build_left", [None, True, False])
def test_hot_cold_null_and_lone_keys(spark, small, build_left):
    left = [(1, i) for i in range(60)] + [(2, 0), (3, 0), (None, 0), (None, 1)] + [(4, i) for i in range(90)] + [(6, 7)]
    right = [(1, i) for i in range(50)] + [(2, i) for i in range(200)] + [(None, 5), (5, 5), (6, 1), (6, 2)]
    want = sorted((a, x, b, y) for a, x in left for b, y in right if a is not None and a == b)
    df = product(spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right, "k bigint, v int"), build_left=build_left)
    assert rows(df) == want
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "int", "bigint", "int"]
    assert most_in_a_task(df) < len(want) // 4  # one key alone has six sevenths


def test_equal_rows_are_dealt_too(spark, small):
    df = product(spark.range(80).selectExpr("id div 1000 AS k"), spark.range(90).selectExpr("id div 1000 AS k"))
    assert df.count() == 7200 and most_in_a_task(df) < 2400


@pytest.mark.parametrize("value", ["x", Decimal("1.50"), datetime.date(2020, 1, 2), True, 1.5, float("nan"), datetime.datetime(2020, 1, 2), bytearray(b"x")])
def test_any_key_gives_the_whole_product(spark, small, value):
    one = spark.createDataFrame([(value, i) for i in range(20)] + [(None, 1)], T.StructType([T.StructField("k", T.DecimalType(10, 2) if isinstance(value, Decimal) else T._infer_type(value)), T.StructField("v", T.LongType())]))
    assert product(one, one).groupBy("n0_c1", "n1_c1").count().agg(F.count("*"), F.max("count")).first()[:] == (400, 1)


def test_several_keys_and_columns_without_an_order(spark, small):
    one = spark.range(200).selectExpr("id % 2 AS a", "CAST(id % 3 AS string) AS b", "id AS v")
    df = product(one, one, [(0, 0), (1, 1)])
    assert df.where("n0_c0 = n1_c0 AND n0_c1 = n1_c1").select("n0_c2", "n1_c2").distinct().count() == df.count() == sum(len(range(k, 200, 6)) ** 2 for k in range(6))
    odd = one.selectExpr("a", "map('v', v) AS m")
    assert joins.dealt_join(odd.toDF("a", "m"), odd.toDF("b", "n"), [("a", "b")]) is None
    assert product(odd, odd).count() == 2 * 100**2


def test_a_small_product_stays_a_plain_join(spark):
    one = spark.range(100).selectExpr("id % 2 AS k")
    assert joins.dealt_join(one.toDF("a"), one.toDF("b"), [("a", "b")]) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_sql_knows_joins_of_many_to_many(spark):
    t = parquet_tables(spark, DATA)

    def many(text, tree=None):
        query = parse(text, lambda x: t(x).columns)
        return [n.many for n in to_plan(query, t, tree or default_tree(query))[0].nodes if hasattr(n, "many")]

    assert many("SELECT s_suppkey FROM supplier, customer WHERE s_nationkey = c_nationkey") == [True]
    assert many("SELECT s_suppkey FROM nation, supplier, customer WHERE n_nationkey = s_nationkey AND s_nationkey = c_nationkey") == [False, True]
    assert many("SELECT l_quantity FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey") == [False, False]
    assert many("SELECT o_orderkey FROM customer, supplier, orders WHERE c_nationkey = s_nationkey AND c_custkey = o_custkey", (("customer", "supplier", None), "orders", None)) == [True, True]
