import pytest
from conftest import rows

from weftline.functions.predicates import Compare, CompareColumns, Like, Not, Ref
from weftline.operators.joins import EqualityClasses, estimated_bytes
from weftline.plans.compiler import compile_plan
from weftline.plans.nodes import Plan, PlanError

INT = "k int"
WORDS = [(1, "xxx"), (1, "yyy"), (None, "zzz"), (2, "uuu"), (3, "vvv")]


def two_scans(spark, left, right, outputs=(0, 1), build_left=True, schema=INT, lcols=None, rcols=None, keys=(0, 0)):
    plan = Plan()
    a = plan.scan(plan.add_input(spark.createDataFrame(left, schema)), lcols)
    b = plan.scan(plan.add_input(spark.createDataFrame(right, schema)), rcols)
    plan.join(a, b, keys, list(outputs), build_left)
    return compile_plan(plan)


@pytest.mark.parametrize("build_left", [True, False, None])
@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ([], [], []),
        ([1], [1], [(1, 1)]),
        ([1, 2, 3], [1, 2, 3], [(1, 1), (2, 2), (3, 3)]),
        ([1, 2, 3], [4, 5, 6], []),
        ([1, 1, 2, 3], [1, 1, 2, 3], [(1, 1)] * 4 + [(2, 2), (3, 3)]),
        ([1, 1, None, 2, 3], [1, 1, None, 2, 3], [(1, 1)] * 4 + [(2, 2), (3, 3)]),
        ([None], [None, 1], []),
        ([-2147483648], [-2147483648], [(-2147483648, -2147483648)]),
    ],
)
def test_one_join(spark, left, right, expected, build_left):
    df = two_scans(spark, [(x,) for x in left], [(x,) for x in right], build_left=build_left)
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "int"]
    assert rows(df) == expected


@pytest.mark.parametrize("build_left", [True, False])
def test_reordered_outputs_with_strings(spark, build_left):
    df = two_scans(spark, WORDS, WORDS, (0, 2, 1), build_left, "k int, s string", [0], [1, 0], (0, 1))
    assert rows(df) == sorted([(1, 1, "xxx")] * 2 + [(1, 1, "yyy")] * 2 + [(2, 2, "uuu"), (3, 3, "vvv")])


@pytest.mark.parametrize(("build_left", "side"), [(True, "BuildLeft"), (False, "BuildRight")])
def test_build_side_reaches_the_physical_plan(spark, build_left, side):
    df = two_scans(spark, [(i,) for i in range(50)], [(i,) for i in range(50)], build_left=build_left)
    assert side in df._jdf.queryExecution().executedPlan().toString()


def test_a_large_build_side_is_not_broadcast(spark):
    plan = Plan()
    big = spark.range(10_000_000).selectExpr("id AS k")
    a, b = plan.scan(plan.add_input(big)), plan.scan(plan.add_input(spark.range(10).selectExpr("id AS k")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        plan.join(a, b, (0, 0), build_left=True)
        assert estimated_bytes(big) > 1 << 20
        text = compile_plan(plan)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in text and "BuildLeft" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trailing_nulls_keep_their_place(spark):
    df = two_scans(spark, [(1, "only")] + [(i, None) for i in range(2, 21)], [(i, None) for i in range(1, 21)], (0, 1), True, "k int, s string")
    assert rows(df)[0] == (1, "only") and all(r[1] is None for r in rows(df)[1:])


@pytest.mark.parametrize("n", [8185, 8186, 20000])
def test_long_strings_are_unchanged(spark, n):
    df = two_scans(spark, [(1, "é" * n)], [(1, "x")], (1,), True, "k int, s string")
    assert df.first()[0] == "é" * n


@pytest.mark.parametrize("kind", ["bigint", "string", "double", "date"])
def test_any_type_is_a_key(spark, kind):
    df = spark.sql(f"SELECT CAST(v AS {kind}) AS k FROM VALUES ('2020'), ('2021'), (NULL) AS t(v)")
    plan = Plan()
    plan.join(plan.scan(plan.add_input(df)), plan.scan(plan.add_input(df)), (0, 0))
    assert compile_plan(plan).count() == 2


def test_several_keys_shared_nodes_and_repeated_outputs(spark):
    plan = Plan()
    node = plan.scan(plan.add_input(spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "a int, b int")))
    plan.join(node, node, [(0, 0), (1, 1)], [0, 0, 3])
    df = compile_plan(plan, ["x", "x", "y"])
    assert df.columns == ["x", "x", "y"]
    assert rows(df) == [(1, 1, 1), (1, 1, 2), (2, 2, 2)]


def test_scan_as_root_and_tree(spark):
    plan = Plan()
    plan.scan(plan.add_input(spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")), [1], Compare(">", Ref("t", "k"), 1))
    assert rows(compile_plan(plan, ["s"])) == [("b",)]
    assert "scan input 0 -> s where" in plan.tree()


def test_bad_plans(spark):
    plan = Plan()
    with pytest.raises(PlanError):
        compile_plan(plan)
    with pytest.raises(PlanError):
        plan.scan(0)
    a = plan.scan(plan.add_input(spark.createDataFrame([(1,)], INT)))
    for keys, outputs in (((0, 1), [0]), ((0, 0), [2]), ([], [0])):
        with pytest.raises(PlanError):
            plan.join(a, a, keys, outputs)
    with pytest.raises(PlanError):
        plan.scan(0, [0], Compare("=", Ref("t", "nope"), 1))


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


@pytest.mark.parametrize(
    ("pattern", "hits"),
    [("a\\%b", ["a\\xb", "a\\b"]), ("a%b", ["a\nb", "a\\xb", "a\\b", "a%b"]), ("a_b", ["a\nb", "a\\b", "a%b"]), ("%", ["a\nb", "a\\xb", "a\\b", "a%b", ""]), ("a/%", []), ("", [""])],
)
def test_like_has_no_escape(spark, pattern, hits):
    df = one_column(spark, ["a\nb", "a\\xb", "a\\b", "a%b", "", None])
    got = df.where(Like(Ref("t", "c"), pattern).to_column(lambda r: df[r.column]))
    assert sorted(r[0] for r in got.collect()) == sorted(hits)


def test_not_drops_nulls(spark):
    df = one_column(spark, [1, 2, None], "int")
    assert rows(df.where(Not(Compare("=", Ref("t", "c"), 1)).to_column(lambda r: df[r.column]))) == [(2,)]
    assert rows(df.where(Compare("=", Ref("t", "c"), 4294967297).to_column(lambda r: df[r.column]))) == []


def test_columns_of_one_table_compare(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, None)], "a int, b int")
    assert rows(df.where(CompareColumns("=", Ref("t", "a"), Ref("t", "b")).to_column(lambda r: df[r.column]))) == [(1, 1)]


def test_equality_classes():
    made = EqualityClasses.of([("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")])
    assert sorted(map(sorted, made.classes())) == [["a", "b", "c", "d"], ["x", "y"]]


def test_streaming_scan_joins_a_table(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, s string").parquet(str(tmp_path / "in"))
    plan = Plan()
    a, b = plan.scan(plan.add_input(stream)), plan.scan(plan.add_input(spark.createDataFrame([(1, 10), (3, 30)], "k int, v int")))
    plan.join(a, b, (0, 0), [1, 3])
    q = compile_plan(plan, ["s", "v"]).writeStream.format("memory").queryName("joined").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert rows(spark.table("joined")) == [("a", 10)]
