"""Approximate nearest neighbours on shifted space-filling curves.

Unit vectors are projected to ``DIMS`` dimensions, ``CURVES`` times: each curve has its own
random rotation, and its own shift of the grid, so that two close vectors which one curve
tears apart lie together on another. A place on a Hilbert curve is a key; all keys are
range-partitioned and sorted once, which gives every vector a rank on each curve. A query
looks at a window of vectors before and after it on every curve; those windows are
merged and reranked by the exact cosine of the original vectors in double precision.

* Equal vectors are one point: a vector that a third of all rows share takes one place on
  each curve, and the point carries its smallest ids, as many as an answer can need.
* Ranks are cut to blocks of ``BLOCK`` points, and the ranks of queries to cells of ``CELL``:
  a group is one block and the queries of one cell that its windows meet, so it holds a bounded
  number of either, however wide the window and large the input.
* Each block answers a query with its best ``k`` points; merging those is one aggregation.

The rotations are random (no fit). The window sets recall: it is calibrated on a bounded
sample of points, whose true neighbours a scan of all points finds, so that ``TARGET`` of
those lie in it. On vectors without structure (isotropic noise) that is a share of all points,
so the work then grows as that of a scan does; the README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 5
CURVES = 12
DIMS = 6
BITS = 8
#: Share of true neighbours that the window is calibrated to find, on how many points.
TARGET, PROBES, LEAST_WINDOW = 0.95, 128, 64
BLOCK, CELL = 1024, 65_536
SEED = 7
#: Hash bins in which the ids of a vector are cut before they meet.
BINS = 64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates 0..2^bits-1, one a row: by
    the transposition of the axes into Gray-coded bit planes, for all points at once."""
    x = cells.astype("u4").copy()
    n = x.shape[1]
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), "u4")
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= t[:, None]
    key = np.zeros(len(x), "u8")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint32(b)) & np.uint32(1)).astype("u8")
    return key


def _rotations(size: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A projection with orthonormal columns and a shift for each curve."""
    rng = np.random.default_rng(seed)
    dims = min(dims, size)
    return [(np.linalg.qr(rng.normal(size=(size, dims)))[0], rng.uniform(0, 1, dims)) for _ in range(curves)]


def curve_keys(unit: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors (one a row) on every curve. Coordinates of a unit vector are
    about normal with deviation 1/sqrt(size): the grid spans three deviations either way,
    plus the shift; what lies beyond falls into the outer cells."""
    size = unit.shape[1]
    side = 1 << bits
    out = np.zeros((len(unit), curves), "u8")
    for c, (turn, shift) in enumerate(_rotations(size, curves, dims, seed)):
        place = (unit @ turn) * np.sqrt(size) / 3  # -1..1 mostly
        cells = np.floor((place + 1) / 2 * (side - 1) + shift)
        out[:, c] = hilbert(np.clip(cells, 0, side - 1), bits)
    return out


def _points(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(vector, ids): distinct usable vectors with the k + 1 smallest ids that have each. A
    vector is usable if it is not null or zero and all its components are finite. Ids are
    cut to that many within hash bins first, so no task gathers all ids of a hot vector."""
    first = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    return (
        _usable(vectors, id_col, vector_col)
        .groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(BINS)).alias("bin"))
        .agg(first(F.collect_set("id")).alias("ids"))
        .groupBy("vector")
        .agg(first(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    )


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows that take part; +0.0 and -0.0 are one number."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + 0.0).alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype("f8").reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # tiny and huge vectors alike
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of every row of ``a`` with every row of ``b``."""
    return (a @ b.T) / np.sqrt((a * a).sum(axis=1))[:, None] / np.sqrt((b * b).sum(axis=1))[None, :]


def _tops(point: np.ndarray, scores: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, score, column) of the ``most`` largest finite scores of each row; ties go to
    the column of the smaller id."""
    out = [(np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8"))]
    for p, s in zip(point, scores, strict=True):
        near = np.flatnonzero(s > -np.inf)
        if len(near) > most:
            near = near[s[near] >= np.partition(s[near], len(near) - most)[len(near) - most]]
        near = near[np.lexsort((least[near], -s[near]))][:most]
        out.append((np.full(len(near), p), s[near], near))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _calibrated(points: DataFrame, ranked: DataFrame, k: int, every: int) -> int:
    """The window at which a sample of ``PROBES`` points finds ``TARGET`` of its true
    neighbours: those come from a scan of all points in blocks, their least distance in
    rank over the curves from the ranks just made."""
    probes = points.orderBy(F.xxhash64("point", F.lit(1))).limit(PROBES).select("point", "vector").toArrow()
    asked, matrix = probes.column("point").to_numpy(), _matrix(probes.column("vector"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, score = b.column("point").to_numpy(), cosine(matrix, _matrix(b.column("vector")))
            score[asked[:, None] == found] = -np.inf
            point, best, at = _tops(asked, score, found, k)
            yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(best), pa.array(found[at])], names=["a", "score", "b"])

    found = points.select("point", "vector").mapInArrow(scan, "a long, score double, b long")
    true = found.groupBy("a").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "b")))), 1, k).alias("near")).select("a", F.explode("near.b").alias("b"))
    pairs = F.broadcast(true)  # PROBES x k rows
    ours, theirs = ranked.join(pairs, ranked["point"] == pairs["a"]).select("curve", "a", "b", "rank"), ranked.join(pairs, ranked["point"] == pairs["b"]).select("curve", "a", "b", F.col("rank").alias("other"))
    gaps = sorted(r["gap"] for r in ours.join(theirs, ["curve", "a", "b"]).groupBy("a", "b").agg(F.min(F.abs(F.col("rank") - F.col("other"))).alias("gap")).collect())
    return max(LEAST_WINDOW, gaps[min(len(gaps) - 1, int(len(gaps) * TARGET))]) if gaps else LEAST_WINDOW


@common.scoped
def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 50, curves: int = CURVES, window: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id divides by ``every``, its ``k``
    nearest found among all other rows; ties go to the smaller id. ``window``: points
    looked at on either side on each curve; calibrated to ``TARGET`` if None.

    Rows with a null id or an unusable vector take no part. A repeated id with the same
    vector is one row; with other vectors, each is a candidate. Vectors of another length
    than the table's most common one can't be compared and take no part.
    """
    spark = vectors.sparkSession
    common.tune(spark)
    nothing = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    sizes = _usable(vectors, id_col, vector_col).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return nothing
    size, kind = sizes[0]["n"], vectors.schema[vector_col].dataType.simpleString()
    fitting = vectors.where(F.size(vector_col) == size)
    points = _points(fitting, id_col, vector_col, k).withColumn("point", F.monotonically_increasing_id())
    points, _ = common.materialize(points.withColumn("vector", F.col("vector").cast(kind)), "points")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = curve_keys(_unit(_matrix(b.column("vector"))), curves)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(curves, dtype="i4"), len(keys))), pa.array(keys.view("i8").ravel()), pa.array(np.repeat(b.column("point").to_numpy(), curves))],
                names=["curve", "key", "point"],
            )

    # One sort of all curves; a rank is the place in the partition plus the rows before that.
    order = points.select("point", "vector").mapInArrow(keyed, "curve int, key long, point long").repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    order, _ = common.materialize(order.select("curve", "point", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "order")
    counts = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    ranked = order.join(F.broadcast(spark.createDataFrame(starts, "part int, first long")), "part").select("curve", "point", (F.col("first") + F.col("at")).alias("rank"))
    ranked, _ = common.materialize(ranked, "ranked")
    wide = window or _calibrated(points, ranked, k, every)
    # A point is asked once for all the rows that have its vector.
    asked = _usable(fitting, id_col, vector_col).where(F.col("id") % every == 0).withColumn("vector", F.col("vector").cast(kind)).distinct()
    asked, _ = common.materialize(asked.join(points.select("vector", "point"), "vector").select("id", "point"), "asked")
    full = ranked.join(points, "point").select("curve", "point", "rank", F.floor(F.col("rank") / BLOCK).alias("block"), "vector", "ids")
    first = F.col("block") * BLOCK
    full = full.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(first - wide, F.lit(0)) / CELL), F.floor((first + BLOCK - 1 + wide) / CELL))))
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - wide, F.lit(0)) / BLOCK), F.floor((F.col("rank") + wide) / BLOCK))
    near = ranked.join(asked.select("point").distinct(), "point").join(points.select("point", "vector"), "point").select("curve", "point", "rank", "vector", F.explode(reach).alias("block"))
    near = near.toDF("q_curve", "q_point", "q_rank", "q_vector", "q_block").withColumn("q_cell", F.floor(F.col("q_rank") / CELL))

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        """Each query's k + 1 best points of one block that lie in its window on its curve."""
        schema = pa.schema([("point", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not len(ours) or not len(theirs):
            return schema.empty_table()
        vec, rank, curve, ids = _matrix(theirs.column("vector")), theirs.column("rank").to_numpy(), theirs.column("curve").to_numpy(), theirs.column("ids").combine_chunks()
        least, out = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()], []
        for start in range(0, len(ours), 512):
            some = ours.slice(start, 512)
            score = cosine(_matrix(some.column("q_vector")), vec)
            score[(np.abs(some.column("q_rank").to_numpy()[:, None] - rank) > wide) | (some.column("q_curve").to_numpy()[:, None] != curve)] = -np.inf
            point, top, at = _tops(some.column("q_point").to_numpy(), score, least, k + 1)
            out.append(pa.table([pa.array(point), pa.array(top), ids.take(pa.array(at))], schema=schema))
        return pa.concat_tables(out)

    found = near.groupBy("q_block", "q_cell").cogroup(full.groupBy("block", "cell")).applyInArrow(best, "point long, score double, ids array<long>")
    # Candidates of a point by id; it keeps k + 1, since each query takes itself out of them.
    places = Window.partitionBy("point").orderBy(F.desc("score"), "id")
    top = found.select("point", "score", F.explode("ids").alias("id")).groupBy("point", "id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(places)).where(F.col("n") <= k + 1)
    lists, _ = common.materialize(top.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("n", F.col("id").alias("other"), "score"))).alias("near")), "lists")
    answers = asked.join(lists, "point").select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    rows = answers.select(F.col("id").alias("query_id"), F.posexplode("near").alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.other").alias("id"), F.col("x.score").alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every fiftieth vector."""
    return search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")
