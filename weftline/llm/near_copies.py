"""Near-duplicates by shingle Jaccard: SimHash and min-hash bands propose, whole shingle sets decide.

Two texts link if the sets of their ``SHINGLE``-word shingles (lower-cased words) have a
Jaccard of 0.8 or more; texts linked directly or through others are one group.

1. Texts with equal shingle sets collapse to one node, with a SimHash fingerprint of its set.
2. Fingerprints at ``DISTANCE`` differing bits or fewer meet by the generalised pigeonhole
   principle (``simhash.links``: groups of bits, thresholds by dynamic programming); nodes of
   one fingerprint meet the first of them.
3. Two sets at 0.8 often differ in more bits than any such index can bear (ten of 64 as a
   rule). For these each node files ``BANDS`` keys of ``ROWS`` min-hashes: two sets at 0.8 share
   none with a chance of (1 - 0.8^4)^24 = 3e-6, and of less above. Buckets with the same members
   are kept once, and members meet the first and the last of their bucket.
4. Every pair that met is verified on whole sets, and what links is joined to components.
5. Buckets whose members are still apart are searched whole: their members are dealt to
   cells of about ``CELL``, and every two cells meet in a task of their own, which hands on a
   spanning forest of all links among their members.

Scale: fingerprints and keys shuffle as 64-bit numbers, shingle sets only for nodes that meet
another, texts never (unless more nodes do than can be broadcast). A large group of near
copies is settled in step 4 by two pairs a member and bucket; step 5 holds the sets of two
cells in a task, however large the bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simhash

SHINGLE = 5
BANDS, ROWS = 24, 4
SEED = 42
#: Bits in which fingerprints that meet differ at most.
DISTANCE = 6
#: Members of a bucket that one side of a whole search holds.
CELL = 256
SKETCH = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("print", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the lower-cased words' shingles, in order; a shorter text is one
    shingle, a text without words has none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), "u8"))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of distinct shingles: the bits set in over half of them; zero without any."""
    ones = np.zeros(simhash.BITS, "i8")
    for at in range(0, len(own), 1 << 15):
        ones += simhash._ones(own[at : at + (1 << 15)])
    return np.packbits(2 * ones > len(own), bitorder="little").view("<i8")


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band: its min-hashes and its number, mixed."""
    rng = np.random.default_rng(SEED)
    by, plus = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype="u8")
    least = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for at in range(0, len(own), 2048):
        least = np.minimum(least, ((by | np.uint64(1)) * own[at : at + 2048] + plus).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype="u8")
    for row in least.reshape(BANDS, ROWS).T:
        keys = simhash._mixed(keys ^ row) + np.uint64(1)
    return keys


def _forest(table: pa.Table) -> pa.Table:
    """Links (a, b) that span all links among the members of a bucket."""
    ids, sets = table.column("fp").to_numpy(), [np.array(s, "i8") for s in table.column("own").to_pylist()]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    sets = np.split(flat.astype("i4"), ends[:-1])
    mark, out = np.zeros(flat.max() + 1, "i4"), []
    left = np.arange(len(sets))
    while len(left):
        front, left = [left[0]], left[1:]
        stale = True
        while front and len(left):
            one = front.pop()
            if stale:
                size = np.array([len(sets[k]) for k in left])
                start, words, stale = np.cumsum(size) - size, np.concatenate([sets[k] for k in left]), False
            mark[sets[one]] = 1
            common_words = np.add.reduceat(mark[words], start)
            mark[sets[one]] = 0
            hit = 9 * common_words >= 4 * (size + len(sets[one]))
            if hit.any():
                out += [(ids[one], ids[k]) for k in left[hit]]
                front += left[hit].tolist()
                left, stale = left[~hit], True
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


@common.scoped
def _close(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes whose fingerprints are equal or within ``DISTANCE``, directly or
    through others. ``nodes``: fp, print."""
    first, _ = common.materialize(nodes.groupBy("print").agg(F.min("fp").alias("first")), "prints")
    found = simhash.links(first.select(F.col("print").alias("fp")), first.count(), DISTANCE)
    a, b = (first.select(F.col("print").alias(side), F.col("first").alias(f"first_{side}")) for side in "ab")
    near = found.join(a, "a").join(b, "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = nodes.select("print", "fp").join(first, "print").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return common.materialize(near.unionByName(same), "close")[0]


@common.scoped
def _links(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """(a, b): links that join all nodes within reach. ``nodes``: fp (the row that stands for
    the node), id, print, keys; ``made``: row, doc.text."""
    close = _close(nodes)
    filed = nodes.select("fp", F.explode("keys").alias("key"))
    buckets = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor(F.xxhash64("fp")).alias("members")).where("n > 1")
    buckets, _ = common.materialize(buckets.groupBy("n", "lo", "hi", "members").agg(F.min("key").alias("key")), "buckets")
    filed, _ = common.materialize(filed.join(buckets.select("key", "lo", "hi"), "key"), "filed")
    met = close.select(F.explode(F.array("a", "b")).alias("row"))
    shared, _ = common.materialize(filed.select(F.col("fp").alias("row")).unionByName(met).distinct(), "shared")

    @F.arrow_udf("array<long>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py()).view("i8") for t in texts], pa.list_(pa.int64()))

    few = shared.limit(simhash.MAX_BROADCAST + 1).count() <= simhash.MAX_BROADCAST
    sets = made.join(F.broadcast(shared) if few else shared, "row").select(F.col("row").alias("fp"), cut(common.whole_text("doc.text")).alias("own"))
    sets, _ = common.materialize(sets, "shingles")
    ends = filed.select(F.col("fp").alias("b"), F.explode(F.array("lo", "hi")).alias("a")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, _ = common.materialize(close.unionByName(ends).distinct(), "pairs")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    near = both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y")))
    near, _ = common.materialize(near.select("a", "b"), "links")
    found, _ = common.materialize(simhash.components(nodes.select("fp", "id"), near).select("fp", F.col("component.row").alias("group")), "groups")
    rest = filed.select("key", "fp").join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    open_, _ = common.materialize(rest.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi AND n > 2").select("key", "n"), "open")
    # Each member goes to its own cell and to the pairs of cells that hold it; one cell is a pair with itself.
    cells = F.ceil(F.col("n") / CELL).cast("int")
    dealt = filed.select("key", "fp").join(open_, "key").withColumn("cell", F.pmod(F.xxhash64("fp"), cells).cast("int"))
    other = F.when(cells == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), cells - 1), lambda c: c != F.col("cell")))
    met = dealt.select("key", "fp", "cell", F.explode(other).alias("other")).select("key", "fp", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"))
    more = met.join(sets, "fp").groupBy("key", "x", "y").applyInArrow(_forest, "a long, b long")
    return near.unionByName(common.materialize(more, "links")[0]).distinct()


@common.scoped
def deduplicate(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (null last; the first of
    repeated rows). Null texts are empty; all texts without words are one group; other columns,
    whatever their names, stay as they are; an empty table stays empty."""
    common.tune(docs.sparkSession)

    @F.arrow_udf(SKETCH)
    def sketched(texts: pa.Array) -> pa.Array:
        import xxhash

        own = [shingles(t.as_py()) for t in texts]
        contents = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary())
        prints = pa.array(np.array([fingerprint(s)[0] for s in own], "i8"))
        return pa.StructArray.from_arrays([contents, prints, pa.array([band_keys(s).view("i8") for s in own], pa.list_(pa.int64()))], names=["content", "print", "keys"])

    rows = common.spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), sketched(common.whole_text()).alias("sketch"))
    made, _ = common.materialize(rows.select("doc", "sketch.content", "sketch.print", "sketch.keys").withColumn("row", F.monotonically_increasing_id()), "sketches")
    keyed = made.select("content", "row", simhash._id(f"doc.`{id_col}`", "row").alias("id"))
    nodes = made.select("content", "print", "keys", simhash._id(f"doc.`{id_col}`", "row").alias("id")).groupBy("content").agg(F.min("id").alias("id"), F.min("print").alias("print"), F.min("keys").alias("keys"))
    nodes, _ = common.materialize(nodes.withColumn("fp", F.col("id.row")), "nodes")
    found = simhash.components(nodes.select("fp", "id"), _links(nodes, made))
    named, _ = common.materialize(nodes.join(found, "fp", "left").select("content", F.coalesce("component", "id").alias("component")), "components")
    losers, _ = common.materialize(keyed.join(named, "content").where(F.col("id") != F.col("component")).select("row"), "losers")
    few = losers.limit(simhash.MAX_BROADCAST + 1).count() <= simhash.MAX_BROADCAST
    kept = made.join(F.broadcast(losers) if few else losers, "row", "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
