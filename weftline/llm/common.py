"""Helpers that the operators share: inputs, shared scratch tables, digests."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker; a batch also ends at ARROW_BYTES.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch, whatever the length of the texts in it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where one partition holds more than two cores' share of its rows: a
    file of few row groups would else keep a narrow pass on few cores. The rows of partitions
    are counted without reading a column; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return df.repartition(3 * cores) if n["most"] and n["most"] * cores > 2 * n["all"] else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; one of our own only on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop_path(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    at, fs = _hadoop_path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def make_folder(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop_path(spark, path)
    fs.mkdirs(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename within one file system."""
    at, fs = _hadoop_path(spark, path)
    if not fs.rename(at, _hadoop_path(spark, to)[0]):
        raise OSError(f"can't move {path} to {to}")


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        at, fs = _hadoop_path(spark, path)
        fs.delete(at, True)


# --- scratch tables and who deletes them

_here = threading.local()


def _open() -> list[list[str]]:
    """The scopes open in this thread, the innermost last: paths made in each."""
    if not hasattr(_here, "scopes"):
        _here.scopes = []
    return _here.scopes


def own_path(spark: SparkSession, name: str) -> str:
    """A fresh path that the scope open in this thread owns."""
    path = fresh_path(spark, name)
    for scope in _open()[-1:]:
        scope.append(path)
    return path


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """What still stands when the driver's JVM ends goes then, whether or not the session was
    stopped before."""
    at, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(at)


def roots(df: DataFrame) -> set[str]:
    """Last parts of the paths that ``df`` reads files from."""
    found, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found |= {paths.apply(i).getName() for i in range(paths.size())}
    return found


@contextlib.contextmanager
def scope(spark: SparkSession, owner: str | None = None) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Owns the scratch tables made within: what the frame that passes through the function it
    gives doesn't read is deleted at the end, also after an error. What that frame reads goes
    to the scope around, or stands until the JVM ends, or until ``release`` where there is an
    ``owner``."""
    made: list[str] = []
    kept: set[str] = set()
    _open().append(made)

    def returned(df: DataFrame) -> DataFrame:
        kept.update(roots(df))
        return df

    try:
        yield returned
    finally:
        _open().pop()
        for path in made:
            if path.rsplit("/", 1)[-1] not in kept:
                drop(spark, path)
            elif _open():
                _open()[-1].append(path)
            elif owner:
                _left().setdefault(owner, []).append(path)


def _left() -> dict[str, list[str]]:
    if not hasattr(_here, "left"):
        _here.left = {}
    return _here.left


def release(spark: SparkSession, reader: DataFrame, but: str) -> None:
    """Delete what other owners than ``but`` left in this thread and ``reader`` doesn't read."""
    read = roots(reader)
    for owner in [o for o in _left() if o != but]:
        paths = _left().pop(owner)
        drop(spark, *(p for p in paths if p.rsplit("/", 1)[-1] not in read))


def scoped(operator: Callable) -> Callable:
    """An operator (its first argument a frame) that leaves only the scratch tables which what
    it returns reads."""
    @wraps(operator)
    def inner(docs: DataFrame, *args, **kwargs):
        with scope(docs.sparkSession) as returned:
            out = operator(docs, *args, **kwargs)
            for frame in out if isinstance(out, tuple) else (out,):
                returned(frame)
            return out

    return inner


def scoped_value(operator: Callable) -> Callable:
    """Alike, for one that returns no frame: none of its scratch tables stays."""
    @wraps(operator)
    def inner(docs: DataFrame, *args, **kwargs):
        with scope(docs.sparkSession):
            return operator(docs, *args, **kwargs)

    return inner


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost
    executor costs a reread. Returns the frame and its path."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def whole_text(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(column: str = "doc_id", parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named in it: inside
    lambdas a plain expression would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Texts of ASCII alone take the quicker built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
