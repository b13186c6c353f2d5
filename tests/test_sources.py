import os
import subprocess
import sys

import pytest
from conftest import rows
from pyspark.sql import types as T

from weftline.functions.predicates import Compare, Ref
from weftline.operators.joins import estimated_bytes
from weftline.sources.files import SubplanCache, from_rows, read_csv, read_parquet, shared_cache, to_rows, to_text, write_csv
from weftline.streaming import append_available, parquet_stream

SCHEMA = "a int, b string, c string"


def csv(spark, tmp_path, text):
    (tmp_path / "t.csv").write_bytes(text.encode())
    return read_csv(spark, str(tmp_path / "t.csv"), spark.createDataFrame([], SCHEMA).schema)


def test_csv_escapes(spark, tmp_path):
    got = rows(csv(spark, tmp_path, '1,"a\\"b","c\\\\d"\n2,"x\ny",\n3,"",plain\n'))
    assert got == [(1, 'a"b', "c\\d"), (2, "x\ny", None), (3, None, "plain")]


def test_csv_line_ends(spark, tmp_path):
    assert rows(csv(spark, tmp_path, "1,a,b\r\n2,c,d\r\n")) == [(1, "a", "b"), (2, "c", "d")]


@pytest.mark.parametrize("text", ["1,a\n", "x,a,b\n"])
def test_csv_errors(spark, tmp_path, text):
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        csv(spark, tmp_path, text).collect()


def test_csv_roundtrip_keeps_nulls_quotes_and_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"uo', "a\nb"), (2, None, "x,y"), (None, "b\\s", "é")], SCHEMA)
    write_csv(df, str(tmp_path / "out"))
    assert rows(read_csv(spark, str(tmp_path / "out"), df.schema)) == rows(df)
    assert rows(read_csv(spark, str(tmp_path / "out"), df.schema, Compare("=", Ref("t", "a"), 1))) == [(1, 'q"uo', "a\nb")]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id % 7 AS b", "CAST(id AS string) AS c").write.parquet(str(tmp_path / "p"))
    df = read_parquet(spark, str(tmp_path / "p"), ["a"], Compare(">", Ref("t", "b"), 5))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,5)" in text and "ReadSchema: struct<a:bigint,b:bigint>" in text
    assert df.count() == 14


def test_rows_and_text(spark):
    df = from_rows(spark, [(1, "a|b\\"), (None, "x\ny")], "k int, s string")
    assert len(to_rows(df)) == 2
    assert to_text(df) == "1|a\\|b\\\\\nNULL|x\\ny"


def test_subplan_cache(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(100).write.parquet(path)
    read = lambda: spark.read.parquet(path).where("id > 10")
    cache = SubplanCache()
    first = cache.get(read())
    assert cache.get(read()) is first and len(cache) == 1 and first.count() == 89
    spark.range(1000).write.mode("overwrite").parquet(path)
    assert cache.get(read()).count() == 989 and len(cache) == 2  # other files
    cache.clear()
    assert not first.is_cached and len(cache) == 0
    size = estimated_bytes(read())
    small = SubplanCache(most_bytes=3 * size)
    kept = [small.get(read().where(f"id > {k}")) for k in range(20, 26)]
    assert small.bytes() <= 3 * size and not kept[0].is_cached and kept[-1].is_cached
    small.clear()
    assert not SubplanCache(most_bytes=1).get(read()).is_cached
    assert shared_cache(spark) is shared_cache(spark)


ODD_FIELDS = [(1, "a,b|c", None), (2, 'say "hi"', "x"), (None, "back\\slash", "end|"), (4, None, " padded ")]


@pytest.mark.parametrize("trailing", [False, True])
@pytest.mark.parametrize("escape", ['"', "\\"])
@pytest.mark.parametrize("sep", [",", "|"])
def test_csv_dialects(spark, tmp_path, sep, escape, trailing):
    schema = T.StructType.fromDDL("k int, name string, note string")
    df = spark.createDataFrame(ODD_FIELDS, schema)
    dialect = {"sep": sep, "escape": escape, "trailing": trailing}
    write_csv(df, str(tmp_path / "t"), **dialect)
    for multiline in (False, True):
        assert sorted(map(str, read_csv(spark, str(tmp_path / "t"), schema, multiline=multiline, **dialect).collect())) == sorted(map(str, df.collect()))


def test_csv_files_by_hand(spark, tmp_path):
    schema = T.StructType.fromDDL("k int, name string")
    (tmp_path / "bars").write_text('1|"a ""b"" c"|\n2|x|\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "bars"), schema, sep="|", escape='"', trailing=True).collect()] == [(1, 'a "b" c'), (2, "x")]
    (tmp_path / "bad").write_text("1|a|\n2|b|c\n")
    with pytest.raises(Exception, match="separator at the end"):
        read_csv(spark, str(tmp_path / "bad"), schema, sep="|", trailing=True).collect()
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "bad"), schema, escape="'")


def test_streams(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (10, 5):
        spark.range(n).write.mode("append").parquet(path)
        append_available(parquet_stream(spark, path, spark.range(1).schema, Compare(">=", Ref("t", "id"), 3)), out, str(tmp_path / "checkpoint"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [3, 3, 4, 4, 5, 6, 7, 8, 9]

def test_entry_works_without_the_corpus_subpackage(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{here}/weftline", f"{here}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "weftline/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), all(not n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(int(out.stdout.split()[0])), "True"], out.stderr
