"""Sources and sinks: Parquet, schema-typed CSV, rows in memory, cached subplans."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.predicates import Predicate, by_name
from weftline.operators.joins import estimated_bytes

#: The column after the last separator of a line that ends with one.
TRAILING = "_after_the_last_separator"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Predicate | None = None) -> DataFrame:
    """Rows of a Parquet table; the filter and the column list reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where.to_column(by_name))
    return df if columns is None else df.select(*[f"`{c}`" for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, where: Predicate | None = None, header: bool = False, sep: str = ",", escape: str = "\\", trailing: bool = False, multiline: bool = True) -> DataFrame:
    """Rows of a CSV table. ``escape``: what stands before a quote within quotes, a backslash
    (before itself too) or a second quote; ``trailing``: each line ends with a separator;
    ``multiline``: quoted line ends are data, for which a file is read by one task; without, files
    are split. An empty field, quoted or not, is null; a row of another width, an open quote or a
    number that can't be read fails the query."""
    if escape not in ('"', "\\"):
        raise ValueError("a quote is escaped by a backslash or a second quote")
    whole = T.StructType([*schema.fields, T.StructField(TRAILING, T.StringType())]) if trailing else schema
    df = spark.read.schema(whole).csv(path, header=header, sep=sep, quote='"', escape=escape, multiLine=multiline, nullValue="", emptyValue="", mode="FAILFAST", enforceSchema=True)
    if trailing:  # what stands after the last separator is an error too
        df = df.where(F.when(F.col(TRAILING).isNull(), True).otherwise(F.raise_error(F.lit("no separator at the end of a line")).cast("boolean"))).drop(TRAILING)
    return df if where is None else df.where(where.to_column(by_name))


def write_csv(df: DataFrame, path: str, header: bool = False, sep: str = ",", escape: str = "\\", trailing: bool = False) -> None:
    """What ``read_csv`` of the same dialect reads back: nulls as empty fields."""
    df = df.withColumn(TRAILING, F.lit(None).cast("string")) if trailing else df
    df.write.mode("overwrite").csv(path, header=header, sep=sep, quote='"', escape=escape, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """A DataFrame of rows in memory."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return df.limit(1) if len(rows) == 1 else df  # its plan then says that there is one row at most


def to_rows(df: DataFrame) -> list[Row]:
    """All rows in the driver; for results that are known to be small."""
    return df.collect()


def to_text(df: DataFrame, sep: str = "|") -> str:
    """Rows as text, one a line; separators, backslashes and line ends are escaped, nulls
    are NULL. For results that are known to be small."""

    def field(v: object) -> str:
        return "NULL" if v is None else str(v).replace("\\", "\\\\").replace(sep, "\\" + sep).replace("\n", "\\n")

    return "\n".join(sep.join(map(field, r)) for r in df.collect())


class SubplanCache:
    """Cached DataFrames, by meaning: a frame whose optimised plan equals one already kept, over
    the same files, reuses it, in this query or a later one. The least recently used go when the
    optimiser's estimates of those kept add up to more than ``most_bytes``; a frame larger than
    that isn't kept. A table that was written anew has other files, so what was kept of it before
    isn't used again. Reuse is exact; nothing is recognised by a sample."""

    def __init__(self, most_bytes: int = 4 << 30):
        self.most_bytes, self._kept = most_bytes, OrderedDict()

    def __len__(self) -> int:
        return sum(map(len, self._kept.values()))

    def bytes(self) -> int:
        return sum(size for kept in self._kept.values() for _, size in kept)

    def get(self, df: DataFrame) -> DataFrame:
        key = (df.semanticHash(), _files(df))
        for other, _ in self._kept.get(key, ()):
            if other.sameSemantics(df):
                self._kept.move_to_end(key)
                return other
        size = estimated_bytes(df)
        if size > self.most_bytes:
            return df
        self._kept.setdefault(key, []).append((df.cache(), size))
        self._kept.move_to_end(key)
        while self.bytes() > self.most_bytes:
            for old, _ in self._kept.popitem(last=False)[1]:
                old.unpersist()
        return df

    def clear(self) -> None:
        while self._kept:
            for df, _ in self._kept.popitem()[1]:
                df.unpersist()


def _files(df: DataFrame) -> tuple[str, ...]:
    """The files that ``df`` was planned over, whether or not it is cached."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found |= set(leaf.relation().location().inputFiles())
    return tuple(sorted(found))


_SHARED: dict[str, SubplanCache] = {}


def shared_cache(spark: SparkSession) -> SubplanCache:
    """The cache that all queries of an application share."""
    return _SHARED.setdefault(spark.sparkContext.applicationId, SubplanCache())
