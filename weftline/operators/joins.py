"""Inner equi joins: build side, single-row sides, keys that both sides repeat, closure of
equalities."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The threshold where the session names none.
DEFAULT_BROADCAST_BYTES = "10MB"
#: Most bytes of one partition that a shuffled hash join may have to hold.
HASHED_BYTES = 64 << 20
#: From here on an estimate says that nothing is known.
UNKNOWN_BYTES = 1 << 62


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's threshold in bytes; -1 if broadcasting is off. A setting that is neither
    is an error."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", DEFAULT_BROADCAST_BYTES).strip()
    if text.startswith("-"):
        return max(-1, int(text.rstrip("bB")))
    return int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def build_hint(df: DataFrame) -> DataFrame:
    """``df`` as the build side of a hash join: broadcast while its estimated size is within
    the session's threshold, else a shuffled hash join while a partition of it fits in memory.
    A larger side is left to the optimiser, whose sort-merge join can spill. Rows of an RDD
    have no estimate; there the plan's word is taken."""
    size = estimated_bytes(df)
    if size <= broadcast_limit(df):
        return F.broadcast(df)
    fits = size <= HASHED_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if fits or size >= UNKNOWN_BYTES else df


#: Types whose values travel as literals.
PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)


def single_row(df: DataFrame) -> Row | None:
    """The only row of ``df``, if its plan says that there can't be another (rows in memory, a
    global aggregate, a limit) and its values are plain; nothing runs for any other frame."""
    if df.isStreaming:
        return None
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    if not most.isDefined() or int(str(most.get())) > 1 or not all(isinstance(f.dataType, PLAIN) for f in df.schema):
        return None
    found = df.collect()
    return found[0] if found else None


def join_single(row: Row, schema: T.StructType, many: DataFrame, keys: list[tuple[str, str]], first: bool) -> DataFrame:
    """A join whose one side is ``row``: a filter on the other, which reaches its scan, and
    constant columns. ``keys``: (column of the row, column of ``many``); a NULL matches nothing.
    ``first``: whether the row's columns stand first."""
    value = {f.name: F.lit(row[f.name]).cast(f.dataType) for f in schema}
    for a, b in keys:
        many = many.where(F.col(f"`{b}`") == value[a])
    ours, theirs = [c.alias(n) for n, c in value.items()], [F.col(f"`{c}`") for c in many.columns]
    return many.select(*ours, *theirs) if first else many.select(*theirs, *ours)


def inner_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], build: str | None = None) -> DataFrame:
    """Inner join on all pairs of columns; NULL keys match nothing. ``build``: "left" or
    "right" picks the side of the hash table."""
    on = [left[a] == right[b] for a, b in keys]
    if build == "left":
        left = build_hint(left)
    elif build == "right":
        right = build_hint(right)
    return left.join(right, on, "inner")


#: Joins of more rows than one task should return are dealt over tasks of about as many.
TASK_ROWS = 1 << 25
#: A key's rows are cut into parts of about so many on either side where both have more; the
#: parts of a pair, a cell, meet in one task, and those of the build side fit in a core's cache.
CELL_SIDE = 1 << 11
#: Most rows of one key, and of one task on average, in the build side of a dealt join.
BUILD_ROWS = 1 << 17
#: Rows that a task copies to cells, about.
COPIED_ROWS = 1 << 22
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Types of keys that are dealt; others have values that are equal without the same bytes, or
#: that don't pass through the driver unchanged.
DEALT_KEYS = (*INTEGRAL, T.StringType, T.BooleanType, T.DateType, T.DecimalType)


def key_types(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> list[T.DataType] | None:
    """The type that each pair of keys is compared in; None where a pair isn't of one type of
    ``DEALT_KEYS`` or of integers."""
    out = []
    for a, b in keys:
        one, two = left.schema[a].dataType, right.schema[b].dataType
        if not (one == two and isinstance(one, DEALT_KEYS) or isinstance(one, INTEGRAL) and isinstance(two, INTEGRAL)):
            return None
        out.append(one if one == two else T.LongType())
    return out


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return isinstance(kind, (*PLAIN, T.BinaryType, T.TimestampNTZType, T.AnsiIntervalType))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], build_left: bool | None = None) -> DataFrame | None:
    """The inner join of two frames without a column name in common, both of which may repeat
    a key; None where it isn't worth more than a plain join.

    A key that both sides repeat returns the product of its rows; tasks by key, or by splits of
    one side, would be few and grow with the square of the input. Rows of keys are therefore
    counted first (one pass over each side). Where the join returns more than ``TASK_ROWS``, each
    key of large product becomes a grid: rows of one side are dealt over its lines and copied to
    all columns, those of the other the reverse, so each pair meets in exactly one cell.
    Tasks get about ``TASK_ROWS`` rows of output each, however large the whole; what crosses the
    network is about a thousandth of the output.

    Rows are dealt by their place in a partition that is sorted by all columns: a task that runs
    again deals them alike, and equal rows are dealt, too."""
    kinds = None if left.isStreaming or right.isStreaming else key_types(left, right, keys)
    if kinds is None or not all(orderable(f.dataType) for f in [*left.schema, *right.schema]):
        return None
    names = [f"_key{i}" for i in range(len(keys))]

    def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
        made = df.select("*", *[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in zip(columns, kinds, names, strict=True)])
        return made.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names)))

    sides = [keyed(left, [a for a, _ in keys]), keyed(right, [b for _, b in keys])]
    found = _counted(sides[0], sides[1], names)
    if found["pairs"] <= TASK_ROWS:
        return None
    grids, first = {}, 0
    for *key, lines, columns in found["large"]:
        grids[*key] = first, lines, columns  # one grid a key, whatever became of its bytes here
        first += lines * columns
    tasks = int(max(found["pairs"] // TASK_ROWS, found["copies"] // BUILD_ROWS)) + 1
    grid = left.sparkSession.createDataFrame([(*key, *at) for key, at in grids.items()], T.StructType([*[T.StructField(f"_of{i}", t) for i, t in enumerate(kinds)], *[T.StructField(n, T.LongType()) for n in ("_first", "_lines", "_columns")]]))
    copiers = max(3 * left.sparkSession.sparkContext.defaultParallelism, int(found["copies"] // COPIED_ROWS))
    one, two = (_dealt(df, grid, names, (copiers, tasks), k == 0) for k, df in enumerate(sides))
    one, two = (one.hint("shuffle_hash"), two) if build_left else (one, two.hint("shuffle_hash"))
    on = [one[n] == two[n] for n in (*names, "_cell")]
    return one.join(two, on, "inner").select(*[one[f"`{c}`"] for c in left.columns], *[two[f"`{c}`"] for c in right.columns])


def _counted(left: DataFrame, right: DataFrame, names: list[str]) -> Row:
    """``pairs``: rows of the join; ``copies``: rows of both sides as ``_dealt`` copies them;
    ``large``: keys to cut, with lines and columns of their grids."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*names).agg(F.count(F.lit(1)).alias(name))

    both = rows(left, "_l").join(rows(right, "_r"), names, "full").fillna(0, ["_l", "_r"])
    l, r, cell = F.col("_l").cast("double"), F.col("_r").cast("double"), float(CELL_SIDE**2)

    def parts(ours: Column, theirs: Column) -> Column:
        """Parts of a side: of CELL_SIDE rows, or of more where the other side has fewer."""
        most = F.least(F.lit(float(BUILD_ROWS)), cell / F.greatest(F.least(theirs, F.lit(float(CELL_SIDE))), F.lit(1.0)))
        return F.greatest(F.ceil(ours / most), F.lit(1)).cast("long")

    large = (l * r > cell) | (F.greatest(l, r) > BUILD_ROWS)
    both = both.select(*names, (l * r).alias("_pairs"), l.alias("_l"), r.alias("_r"), F.when(large, parts(l, r)).otherwise(1).alias("_lines"), F.when(large, parts(r, l)).otherwise(1).alias("_columns"))
    cut = F.col("_lines") * F.col("_columns") > 1
    return both.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0)).alias("pairs"), F.sum(l * F.col("_columns") + r * F.col("_lines")).alias("copies"), F.collect_list(F.when(cut, F.struct(*names, "_lines", "_columns"))).alias("large")).first()


def _dealt(df: DataFrame, grid: DataFrame, names: list[str], tasks: tuple[int, int], lines: bool) -> DataFrame:
    """Rows of one side with the ``_cell`` they belong to, copied to every cell of their line
    (or column); -1 where their key isn't cut. ``tasks``: how many copy, and how many join."""
    at = df.repartition(tasks[0]).sortWithinPartitions(*names, *[f"`{c}`" for c in df.columns if c not in names]).select("*", F.monotonically_increasing_id().alias("_at"))
    many = at.join(F.broadcast(grid), [at[n] == grid[f"_of{i}"] for i, n in enumerate(names)], "left")
    first, height, width = F.coalesce("_first", F.lit(-1)), F.coalesce("_lines", F.lit(1)), F.coalesce("_columns", F.lit(1))
    start, step, n = (first + F.col("_at") % height * width, F.lit(1).cast("long"), width) if lines else (first + F.col("_at") % width, width, height)
    cells = F.explode(F.sequence(start, start + (n - 1) * step, step))
    return many.select(*[f"`{c}`" for c in df.columns], cells.alias("_cell")).repartition(tasks[1], *names, "_cell")


class EqualityClasses:
    """Union-find over anything that equalities link."""

    def __init__(self):
        self._up: dict[Hashable, Hashable] = {}

    def _top(self, x: Hashable) -> Hashable:
        self._up.setdefault(x, x)
        while self._up[x] != x:
            self._up[x] = self._up[self._up[x]]
            x = self._up[x]
        return x

    def link(self, a: Hashable, b: Hashable) -> None:
        self._up[self._top(b)] = self._top(a)

    def classes(self) -> list[list[Hashable]]:
        """Members of each class, in order of first mention."""
        out: dict[Hashable, list[Hashable]] = {}
        for x in self._up:
            out.setdefault(self._top(x), []).append(x)
        return list(out.values())

    @classmethod
    def of(cls, pairs: Iterable[tuple[Hashable, Hashable]]) -> EqualityClasses:
        made = cls()
        for a, b in pairs:
            made.link(a, b)
        return made
