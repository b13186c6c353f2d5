"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two link at ``DISTANCE`` differing bits or fewer. Split the bits
into m groups and give group i a threshold t_i with sum(t_i + 1) = DISTANCE + 1: linked
fingerprints then differ in at most t_i bits of some group i. So

1. fingerprints are made once for each row and collapsed to distinct ones;
2. bits that vary together on a sample are put into the same group, and a dynamic programme
   over the groups shares out the thresholds (-1 skips a group) so that the estimated
   probes and candidates are fewest; m itself is chosen the same way;
3. each fingerprint is filed under its group values, and under all values of its group that
   leave out t_i bits, so that any two within t_i meet in a bucket;
4. buckets are read in key order and verified on all 64 bits; a bucket hands on a spanning
   forest of its links, never its pairs. One of more than ``HOT`` members is first cut by the
   same principle: its members are filed anew under ``DISTANCE + 1`` groups of bits that are
   spread over all 64, on one of which any two linked members agree;
5. links between distinct fingerprints are joined to components by alternating star
   contraction; every row gets the smallest doc_id of its component.

Scale: rows shuffle as 64-bit numbers; texts never do. Copies collapse before anything is
paired, so a text that a third of all rows share is one fingerprint. A bucket is streamed
in blocks of ``BLOCK`` fingerprints: members that a component of the bucket has absorbed
are tested against only what is still apart, so a dense group costs about its size. In the
contraction, what a node's neighbours amount to is a table of its own, so that adaptive
execution can split the node's side of the joins. The driver sees a sample of ``SAMPLE``
fingerprints and counts, no links or components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 4000
#: Bucket members tested against each other at once.
BLOCK = 2048
#: Members from which on a bucket is cut.
HOT = 20_000
#: Most row numbers that are broadcast (8 bytes each).
MAX_BROADCAST = 500_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles; zero without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype="<u8", count=n)
    ones = np.zeros(BITS, "int64")
    for start in range(0, len(hashes), 1 << 15):
        ones += _ones(hashes[start : start + (1 << 15)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set. Bits are counted eight at a time, as the
    bytes of a sum of spread-out bits: up to 255 hashes fit before a byte carries."""
    total = np.zeros(BITS, "int64")
    for k in range(8):  # bits k, k+8, ... of every byte
        part = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        full = len(part) // 255 * 255
        sums = part[:full].reshape(-1, 255).sum(axis=1, dtype="u8").view("u1").reshape(-1, 8).sum(axis=0, dtype="int64") if full else 0
        sums = sums + part[full:].sum(dtype="u8", keepdims=True).view("u1").astype("int64")
        total[k::8] = sums
    return total


def fingerprints(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc, fp): the row as it came, without its text unless ``keep_text``, and its
    fingerprint as a long."""
    common.tune(docs.sparkSession)

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype="u8").view("i8"))

    return common.spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]).alias("doc"), hashed(common.whole_text()).alias("fp"))


# --- the plan: groups of bits and their thresholds


def group_bits(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Bits that vary together share a group; groups differ by one bit in size at most. Each
    group starts at the free bit that correlates most and takes the bits closest to it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype="u8")) & np.uint64(1)).astype("float64")
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(near, 0)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        left = sorted(free)
        own = [max(left, key=lambda b: (near[b, left].max(), -b))]
        free.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(free), key=lambda b: near[b, own].sum())
            own.append(nxt)
            free.discard(nxt)
        out.append(sorted(own))
    return out


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), "u8")
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def allocate(sample: np.ndarray, groups: list[list[int]], rows: int, distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least estimated cost: by
    dynamic programming over groups, with what each threshold would cost there. A key filed
    counts 1, a pair verified ``1/50``."""
    pairs, scale = [], rows / max(2, len(sample))
    for bits in groups:
        v, seen = _values(sample, bits), np.zeros(BITS + 1)
        for k in range(1, len(v)):
            seen += np.bincount(np.bitwise_count(v[k:] ^ v[:-k]), minlength=BITS + 1)
        pairs.append(np.cumsum(seen))

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        return rows * comb(len(groups[i]), t) + pairs[i][t] * scale**2 / 50

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(groups)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(distance - used, 2) + 1):
                new = (c + cost(i, t), [*ts, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[distance + 1]


def plan(sample: np.ndarray, rows: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group in use."""
    options = []
    for m in range(2, distance + 2):
        groups = group_bits(sample, m)
        try:
            options.append((*allocate(sample, groups, rows, distance), groups))
        except KeyError:  # so few groups can't hold the distance at these thresholds
            continue
    _, thresholds, groups = min(options, key=lambda o: o[0])
    return [(b, t) for b, t in zip(groups, thresholds, strict=True) if t >= 0]


# --- probing and verifying


@lru_cache(maxsize=64)
def _masks(bits: tuple[int, ...], t: int) -> np.ndarray:
    """What is left of the group's bits after t of them are left out."""
    whole = sum(1 << b for b in bits)
    return np.array([whole & ~sum(1 << b for b in out) for out in combinations(bits, t)], dtype="u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers): it is one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _filed(batches: Iterator[pa.RecordBatch], parts: list[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each mask. The key mixes the masked bits with the mask's number: two
    masks may share a key by chance, which only adds a pair to verify."""
    masks = np.concatenate([_masks(tuple(b), t) for b, t in parts])
    salt = _mixed(np.arange(1, len(masks) + 1, dtype="u8"))
    for batch in batches:
        fps = batch.column("fp").to_numpy().view("u8")
        for start in range(0, len(fps), 4096):
            own = fps[start : start + 4096]
            keys = _mixed((own[:, None] & masks) ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("i8")), pa.array(np.repeat(own, len(masks)).view("i8"))], names=["key", "fp"])


def _cut(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(key, fp) of large buckets, filed anew: each member once for each of ``distance + 1``
    groups of bits, under its bucket's key and its bits in that group."""
    groups = np.array([sum(1 << b for b in range(g, BITS, distance + 1)) for g in range(distance + 1)], dtype="u8")
    salt = _mixed(np.arange(1, len(groups) + 1, dtype="u8"))
    for batch in batches:
        keys, fps = (batch.column(c).to_numpy().view("u8") for c in ("key", "fp"))
        made = _mixed(_mixed((fps[:, None] & groups) ^ salt) ^ keys[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(made.ravel().view("i8")), pa.array(np.repeat(fps, len(groups)).view("i8"))], names=["key", "fp"])


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links within one bucket. Each member reached is
    tested against those not reached yet, in blocks, so what is absorbed costs no more."""
    if len(fps) <= 512:  # most buckets hold no link: one look tells
        near = np.bitwise_count(fps[:, None] ^ fps) <= distance
        lonely = near.sum(axis=1) == 1
        if lonely.all():
            return []
        fps = fps[~lonely]
    left, out = fps.copy(), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), "u8")
            hit = np.zeros(len(left), bool)
            rows = max(1, (BLOCK * BLOCK) // max(1, len(left)))
            for start in range(0, len(front), rows):
                some = front[start : start + rows]
                open_ = np.flatnonzero(~hit)
                if not len(open_):
                    break
                for at in range(0, len(open_), BLOCK * BLOCK):
                    own = open_[at : at + BLOCK * BLOCK]
                    near = np.bitwise_count(some[:, None] ^ left[own]) <= distance
                    found = near.any(axis=0)
                    reached[own[found]] = some[near.argmax(axis=0)[found]]
                    hit[own[found]] = True
            out.append((reached[hit], left[hit]))
            front, left = left[hit], left[~hit]
    return out


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b), a < b, of the buckets in a partition sorted by key. Short buckets are
    tested all at once by lag; a longer one is gathered whole (8 bytes a member)."""
    def emit(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate([np.zeros(0, "u8"), *a]), np.concatenate([np.zeros(0, "u8"), *b])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view("i8")), pa.array(np.maximum(a, b).view("i8"))], names=["a", "b"])

    def closed(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        short = np.repeat(size <= 16, size)
        k, f = key[short], fp[short]
        for lag in range(1, min(16, len(k))):
            near = (k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= distance)
            a.append(f[:-lag][near])
            b.append(f[lag:][near])
        for at, n in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            for x, y in _forest(fp[at : at + n], distance):
                a.append(x)
                b.append(y)
        return emit(a, b)

    gathered: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view("u8")
        if not len(k):
            continue
        gathered.append((k, f))
        held += len(k)
        if held < 65536 or k[-1] == gathered[0][0][0]:
            continue
        key, fp = (np.concatenate(x) for x in zip(*gathered, strict=True))
        cut = len(key) - int(np.argmax(key[::-1] != key[-1]))  # the last bucket may go on
        yield closed(key[:cut], fp[:cut])
        gathered, held = [(key[cut:], fp[cut:])], len(key) - cut
    if gathered:
        key, fp = (np.concatenate(x) for x in zip(*gathered, strict=True))
        yield closed(key, fp)


@common.scoped
def links(fps: DataFrame, rows: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that join every two fingerprints within ``distance``, directly or
    through others. ``fps``: distinct fp."""
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype="i8").view("u8")
    parts = plan(sample, rows, distance) if len(sample) > 1 else [(list(range(BITS)), 0)]
    filed = fps.select("fp").mapInArrow(lambda b: _filed(b, parts), "key long, fp long")
    large, _ = common.materialize(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "large")
    if large.limit(1).count():
        again = filed.join(large, "key", "left_semi").select("key", "fp").mapInArrow(lambda b: _cut(b, distance), "key long, fp long")
        filed = filed.join(large, "key", "left_anti").select("key", "fp").unionByName(again)
    found = filed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _linked(b, distance), "a long, b long")
    return found.distinct()


# --- components


@common.scoped
def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component): for each node of an edge, the smallest ``id`` it reaches. ``nodes``:
    fp, id; ``edges``: a, b.

    Nodes get ranks by their id, so that contracting to smaller neighbours ends at the
    smallest id: alternating large-star and small-star steps, until an edge set repeats.
    Each round is written to the shared folder and the one before it deleted.
    """
    spark = nodes.sparkSession
    a, b = nodes.select(F.col("fp").alias("a"), F.struct("id", "fp").alias("x")), nodes.select(F.col("fp").alias("b"), F.struct("id", "fp").alias("y"))
    pairs = edges.join(a, "a").join(b, "b").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    now, path = common.materialize(pairs, "star")
    before = None
    while True:
        # Large star: each node's larger neighbours move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v"))
        large, large_path = common.materialize(moved.distinct(), "star")
        # Small star: its smaller neighbours, and itself, move to the smallest.
        low, low_path = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v"))
        after, new_path = common.materialize(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        common.drop(spark, path, least_path, large_path, low_path)
        now, path = after, new_path
        if before == state:
            break
        before = state
    rest = now.select("u.fp", F.col("v.id").alias("component"))
    return rest.unionByName(now.select("v.fp", F.col("v.id").alias("component"))).distinct()


@common.scoped
def _named(made: DataFrame, distance: int) -> DataFrame:
    """(fp, component) for every fingerprint of ``made`` (fp, id), written out so that the
    join with rows can split a fingerprint that many share."""
    nodes, _ = common.materialize(made.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    found = components(nodes, links(nodes.select("fp"), nodes.count(), distance))
    return common.materialize(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "id").alias("component")), "components")[0]


def _id(column: str, *ties: str) -> Column:
    """Ids in order, null last; a row number settles ties."""
    return F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("id"), *ties)


@common.scoped
def group(docs: DataFrame, id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(doc, fp, component): each row with its fingerprint and the smallest id it reaches.

    Null texts are empty; their fingerprint, and that of any text without words, is zero.
    A null id takes part in links but names a component only if it has no other id (then
    the component is null). Repeated rows are one fingerprint and each return.
    """
    made, _ = common.materialize(fingerprints(docs), "fingerprints")
    named = _named(made.select("fp", _id(f"doc.`{id_col}`").alias("id")), distance)
    return made.join(named, "fp", "left").select("doc", "fp", F.col("component.id").alias("component"))


@common.scoped
def deduplicate(docs: DataFrame, id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (the first of
    repeated rows). Texts are written once with their fingerprints; the rows to drop go
    back to them as a broadcast of row numbers only if they are counted and few."""
    made, _ = common.materialize(fingerprints(docs, keep_text=True).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    keyed = made.select("fp", "row", _id(f"doc.`{id_col}`", "row").alias("id"))
    named = _named(keyed.select("fp", "id"), distance)
    losers, _ = common.materialize(keyed.join(named, "fp").where(F.col("id") != F.col("component")).select("row"), "losers")
    few = losers.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    kept = made.join(F.broadcast(losers) if few else losers, "row", "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents' fingerprints."""
    found = group(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
