"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.predicates import Between, Compare, In, IsNotNull, IsNull, Like, Not, Predicate, Ref
from weftline.operators.joins import inner_join
from weftline.plans import explain_json
from weftline.plans.catalog import parquet_tables
from weftline.plans.compiler import compile_plan
from weftline.plans.nodes import Plan
from weftline.plans.sqlfront import execute, oracle_text, parse
from weftline.sources.files import from_rows, read_csv, read_parquet, shared_cache, write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def positions(df: DataFrame, *names: str) -> list[int]:
    return [df.columns.index(n) for n in names]


# --- scans, projections, sources


@query("SELECT n_name, n_nationkey FROM nation")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan()
    df = parquet_tables(spark, d)("nation")
    plan.scan(plan.add_input(df), positions(df, "n_name", "n_nationkey"))
    return compile_plan(plan, ["n_name", "n_nationkey"])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A table through CSV and back."""
    df, path = parquet_tables(spark, d)("supplier"), shared_folder(spark, "csv", d)
    write_csv(df, path)
    return read_csv(spark, path, df.schema, Compare(">", Ref("supplier", "s_acctbal"), 0))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def csv_dialect(spark: SparkSession, d: str) -> DataFrame:
    """Bars, doubled quotes and a separator at the end of each line; files are split."""
    df, path = parquet_tables(spark, d)("orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus"), shared_folder(spark, "bars", d)
    dialect = {"sep": "|", "escape": '"', "trailing": True}
    write_csv(df, path, **dialect)
    return read_csv(spark, path, df.schema, Compare("=", Ref("orders", "o_orderstatus"), "F"), multiline=False, **dialect).drop("o_orderstatus")


def shared_folder(spark: SparkSession, name: str, d: str) -> str:
    """A folder that driver and executors share: the session's, or one of our own on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext._jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/weftline-{name}-{md5(d.encode()).hexdigest()[:12]}"


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) AS a(k, name) JOIN (VALUES (1, 10.5), (1, 11.5), (4, 40.5)) AS b(k2, v) ON k = k2".replace("SELECT *", "SELECT k, name, CAST(v AS DOUBLE) AS v"))
def inline_rows_join(spark: SparkSession, d: str) -> DataFrame:
    a = from_rows(spark, [(1, "one"), (2, "two"), (3, "three")], "k int, name string")
    b = from_rows(spark, [(1, 10.5), (1, 11.5), (4, 40.5)], "k2 int, v double")
    return inner_join(a, b, [("k", "k2")]).select("k", "name", "v")


# --- filters


def part_filter(name: str, where: Predicate, sql: str, columns: str = "p_partkey, p_size") -> None:
    wanted = columns.split(", ")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return read_parquet(spark, f"{d}/part.parquet", wanted, where)

    run.__name__ = name
    query(f"SELECT {columns} FROM part WHERE {sql}")(run)


SIZE, NAME, BRAND = Ref("part", "p_size"), Ref("part", "p_name"), Ref("part", "p_brand")
for key, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    part_filter(f"filter_{key}", Compare(op, SIZE, 25), f"p_size {op} 25")
part_filter("filter_like", Like(NAME, "%widget%") & ~Like(NAME, "cold%"), "p_name LIKE '%widget%' AND p_name NOT LIKE 'cold%'", "p_partkey, p_name")
part_filter("filter_not_like", Not(Like(NAME, "_old%")), "p_name NOT LIKE '_old%'", "p_partkey, p_name")
part_filter("filter_between", Between(SIZE, 10, 20), "p_size BETWEEN 10 AND 20")
part_filter("filter_in", In(BRAND, ("Brand#13", "Brand#22")), "p_brand IN ('Brand#13', 'Brand#22')", "p_partkey, p_brand")
part_filter("filter_and_or", (Like(NAME, "%widget%") | Compare(">", SIZE, 40)) & Compare("<>", BRAND, "Brand#13"), "(p_name LIKE '%widget%' OR p_size > 40) AND p_brand <> 'Brand#13'", "p_partkey, p_size, p_brand")

NULLABLE = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 7 END AS k FROM part"


def nullable(spark: SparkSession, d: str) -> DataFrame:
    return read_parquet(spark, f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_size") % 7).alias("k"))


def null_filter(name: str, where: Predicate, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        plan = Plan()
        plan.scan(plan.add_input(nullable(spark, d)), where=where)
        return compile_plan(plan, ["p_partkey", "k"])

    run.__name__ = name
    query(f"SELECT p_partkey, k FROM ({NULLABLE}) WHERE {sql}")(run)


K = Ref("part", "k")
null_filter("filter_is_null", IsNull(K), "k IS NULL")
null_filter("filter_is_not_null", IsNotNull(K), "k IS NOT NULL")
null_filter("filter_not", Not(Compare("=", K, 3)), "NOT (k = 3)")


# --- joins


def two_way(spark: SparkSession, d: str, build_left: bool | None) -> DataFrame:
    t, plan = parquet_tables(spark, d), Plan()
    c, o = t("customer"), t("orders")
    left = plan.scan(plan.add_input(c), positions(c, "c_custkey", "c_name"), Compare("=", Ref("c", "c_mktsegment"), "FURNITURE"))
    right = plan.scan(plan.add_input(o), positions(o, "o_custkey", "o_totalprice"))
    plan.join(left, right, (0, 0), [1, 3], build_left)
    return compile_plan(plan, ["c_name", "o_totalprice"])


TWO_WAY = "SELECT c_name, o_totalprice FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'FURNITURE'"


@query(TWO_WAY)
def join_inner_equi(spark: SparkSession, d: str) -> DataFrame:
    return two_way(spark, d, None)


@query(TWO_WAY)
def join_build_left(spark: SparkSession, d: str) -> DataFrame:
    return two_way(spark, d, True)


@query(TWO_WAY)
def join_build_right(spark: SparkSession, d: str) -> DataFrame:
    return two_way(spark, d, False)


@query("SELECT 'seven' AS label, c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def join_single_row_auto(spark: SparkSession, d: str) -> DataFrame:
    """Nobody says that one side is a single row: its plan does, and the join becomes a filter
    that reaches the other side's scan."""
    c, plan = parquet_tables(spark, d)("customer"), Plan()
    one = plan.scan(plan.add_input(from_rows(spark, [(7, "seven")], "k int, label string")), [0, 1])
    many = plan.scan(plan.add_input(c), positions(c, "c_nationkey", "c_custkey", "c_name"))
    plan.join(one, many, [(0, 0)], [1, 3, 4], None)
    return compile_plan(plan, ["label", "c_custkey", "c_name"])


@query("SELECT n_name, c_custkey, c_name FROM nation, customer WHERE n_nationkey = c_nationkey AND n_nationkey = 7")
def join_single_row(spark: SparkSession, d: str) -> DataFrame:
    """One row on one side: it is broadcast, and its key also filters the other side."""
    t, plan = parquet_tables(spark, d), Plan()
    n, c = t("nation"), t("customer")
    one = plan.scan(plan.add_input(n), positions(n, "n_nationkey", "n_name"), Compare("=", Ref("n", "n_nationkey"), 7))
    many = plan.scan(plan.add_input(c), positions(c, "c_nationkey", "c_custkey", "c_name"))
    plan.join(one, many, (0, 0), [1, 3, 4], True)
    return compile_plan(plan, ["n_name", "c_custkey", "c_name"])


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan()
    n = parquet_tables(spark, d)("nation")
    one = plan.scan(plan.add_input(n), positions(n, "n_regionkey", "n_name"))
    plan.join(one, one, (0, 0), [1, 3], many=True)
    return compile_plan(plan, ["a_name", "b_name"])


@query("SELECT a.k AS k, a.p_partkey AS a_key, b.c_custkey AS c_key FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS k FROM part) a, (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 50 END AS k FROM customer) b WHERE a.k = b.k")
def join_null_keys(spark: SparkSession, d: str) -> DataFrame:
    t = parquet_tables(spark, d)
    a = t("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_size")).alias("k"))
    b = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("c_custkey") % 50).alias("k"))
    plan = Plan()
    plan.join(plan.scan(plan.add_input(a)), plan.scan(plan.add_input(b)), (1, 1), [1, 0, 2], many=True)
    return compile_plan(plan, ["k", "a_key", "c_key"])


@query("SELECT c_mktsegment, o_orderpriority, c_name, o_orderstatus FROM orders, customer WHERE o_custkey = c_custkey")
def join_varchar_payload(spark: SparkSession, d: str) -> DataFrame:
    t, plan = parquet_tables(spark, d), Plan()
    o, c = t("orders"), t("customer")
    left = plan.scan(plan.add_input(o), positions(o, "o_custkey", "o_orderpriority", "o_orderstatus"))
    right = plan.scan(plan.add_input(c), positions(c, "c_name", "c_custkey", "c_mktsegment"))
    plan.join(left, right, (0, 1), [5, 1, 3, 2])
    return compile_plan(plan, ["c_mktsegment", "o_orderpriority", "c_name", "o_orderstatus"])


@query("SELECT o_totalprice AS price, c_custkey AS k1, o_custkey AS k2, c_custkey AS k3, c_acctbal AS balance FROM customer, orders WHERE c_custkey = o_custkey")
def join_project_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Outputs left out, reordered and repeated."""
    t, plan = parquet_tables(spark, d), Plan()
    c, o = t("customer"), t("orders")
    left = plan.scan(plan.add_input(c), positions(c, "c_acctbal", "c_custkey"))
    right = plan.scan(plan.add_input(o), positions(o, "o_totalprice", "o_custkey"))
    plan.join(left, right, (1, 1), [2, 1, 3, 1, 0])
    return compile_plan(plan, ["price", "k1", "k2", "k3", "balance"])


# --- by SQL text


def by_sql(name: str, text: str, tree=None, mode: str = "agg", oracle: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = parquet_tables(spark, d)
        return execute(parse(text, lambda x: t(x).columns), t, mode, tree)

    run.__name__ = name
    query(oracle or text)(run)


by_sql("join_dup_keys", "SELECT s.s_suppkey AS s_key, c.c_custkey AS c_key, s.s_nationkey AS nation FROM supplier s, customer c WHERE s.s_nationkey = c.c_nationkey")
by_sql("join_empty_build", "SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_custkey < 0")
by_sql("join_three_way", "SELECT r_name, n_name, c_name FROM region, nation, customer WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND r_name = 'ASIA'")
SIX_WAY = "SELECT r.r_name AS r_name, n.n_name AS n_name, c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey, l.l_linenumber AS l_linenumber, s.s_name AS s_name FROM region r, nation n, customer c, orders o, lineitem l, supplier s WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND l.l_quantity < 10"
by_sql("join_six_way", SIX_WAY)
by_sql("join_bushy", "SELECT n_name, c_name, o_orderkey, l_linenumber FROM nation, customer, orders, lineitem WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_quantity > 40", (("nation", "customer", True), ("orders", "lineitem", True), None))
by_sql("join_transitive", "SELECT n.n_name AS n_name, c.c_custkey AS c_custkey, s.s_suppkey AS s_suppkey FROM nation n, customer c, supplier s WHERE n.n_nationkey = c.c_nationkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2", (("n", "s", None), "c", None))
by_sql("join_multi_key", "SELECT c.c_custkey AS c_custkey, s.s_suppkey AS s_suppkey, n.n_name AS n_name FROM customer c, supplier s, nation n WHERE c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND n.n_nationkey = s.s_nationkey")
by_sql("join_residual_or", "SELECT c.c_custkey AS c_custkey, n.n_name AS n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND (c.c_acctbal > 9000 OR n.n_regionkey = 1)")
by_sql("filter_pushdown_join", "SELECT c_name, o_orderkey, l_extendedprice FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority LIKE '1%' AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag <> 'R'")
by_sql("sql_multi_arg", "SELECT MIN(c.c_custkey, c.c_name), COUNT(o.o_orderkey) FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' -- columns of both", mode="raw", oracle="SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
by_sql("sql_count_pairs", "SELECT COUNT(c.c_custkey, o.o_orderkey) AS n FROM customer c, orders o WHERE c.c_custkey = o.o_custkey", oracle="SELECT COUNT(*) AS n FROM customer c, orders o WHERE c.c_custkey = o.o_custkey")
RAW = "SELECT MIN(c.c_name) AS first_name, MIN(o.o_totalprice) AS price FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'"
by_sql("sql_two_way", RAW, mode="raw", oracle="SELECT c.c_name AS first_name, o.o_totalprice AS price FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
by_sql("job_like_min", "SELECT MIN(n.n_name) AS nation, MIN(c.c_name) AS customer, MIN(o.o_totalprice) AS price, MIN(s.s_name) AS supplier FROM nation n, customer c, orders o, lineitem l, supplier s WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND (c.c_mktsegment = 'BUILDING' OR c.c_mktsegment LIKE 'M%') AND l.l_quantity BETWEEN 5 AND 45 AND s.s_name IS NOT NULL AND o.o_orderstatus <> 'P'")


@query(SIX_WAY)
def imported_plan(spark: SparkSession, d: str) -> DataFrame:
    """The six-way join in the shape, and with the build sides, of an optimiser's plan."""

    def scan(alias: str) -> dict:
        return {"Node Type": "Seq Scan", "Alias": alias}

    def joined(probe: dict, build: dict) -> dict:
        return {"Node Type": "Hash Join", "Plans": [probe, {"Node Type": "Hash", "Plans": [build]}]}

    tree = joined(joined(scan("l"), scan("s")), joined(scan("o"), joined(scan("c"), joined(scan("n"), scan("r")))))
    return explain_json.run(SIX_WAY, {"Node Type": "Gather", "Plans": [tree]}, parquet_tables(spark, d))


@query("SELECT a.n_name AS n_name, a.c_custkey AS c_custkey, b.c_custkey AS other FROM (SELECT n_name, n_nationkey, c_custkey FROM nation, customer WHERE n_nationkey = c_nationkey AND c_acctbal > 9000) a, (SELECT n_nationkey, c_custkey FROM nation, customer WHERE n_nationkey = c_nationkey AND c_acctbal > 9000) b WHERE a.n_nationkey = b.n_nationkey")
def cached_subplan(spark: SparkSession, d: str) -> DataFrame:
    """The same subplan twice; the second is answered from the cache."""
    cache, t = shared_cache(spark), parquet_tables(spark, d)

    def sub() -> DataFrame:
        return cache.get(inner_join(t("nation"), t("customer").where("c_acctbal > 9000"), [("n_nationkey", "c_nationkey")]).select("n_name", "n_nationkey", "c_custkey"))

    a, b = sub(), sub()
    plan = Plan()
    plan.join(plan.scan(plan.add_input(a)), plan.scan(plan.add_input(b), positions(b, "n_nationkey", "c_custkey")), (1, 0), [0, 2, 4], many=True)
    return compile_plan(plan, ["n_name", "c_custkey", "other"])


@query("SELECT n_regionkey, COUNT(*) AS n, MIN(c_name) AS first_name FROM nation, customer WHERE n_nationkey = c_nationkey AND c_acctbal > 9500 GROUP BY n_regionkey")
def cached_across_queries(spark: SparkSession, d: str) -> DataFrame:
    """A build side that an earlier query has cached is answered from there."""

    def sub() -> DataFrame:
        t = parquet_tables(spark, d)
        return shared_cache(spark).get(inner_join(t("nation"), t("customer").where("c_acctbal > 9500"), [("n_nationkey", "c_nationkey")]).select("n_regionkey", "c_name"))

    sub().count()  # the earlier query
    return sub().groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first_name"))


__all__ = ["ORACLE_SQL", "QUERIES", "oracle_text"]
