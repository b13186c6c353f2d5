"""Resharding by minimum-cost flow.

Rows hash to blocks by their text, so equal texts travel together. A text that by itself is
larger than a sixteenth of a shard is hot: it leaves its block and is cut by a salt into parts
of about that size, so that it can't overfill a shard; other texts are never torn apart. A
block, or a part of a hot text, is the unit of transfer:

1. One aggregation gives bytes and rows of every block of every old shard; where a block is
   large, a second one finds the hot texts in it.
2. A transport network (old shards -> new shards; staying is free, moving costs one a
   byte) is solved by successive shortest paths. Its optimum moves the fewest bytes that
   meet the new capacities.
3. Units are dealt, largest first, to the flows that leave their old shard, then small
   corrections level what whole units can't split. Rows join their unit's new shard.
4. ``rewrite`` writes only the shards that gained or lost a row; ``migrate`` does all of it to
   a folder of shards.

Scale: the driver holds unit totals only: ``BLOCKS`` for each old shard that a block lies in,
and sixteen hot parts a shard about. Texts never shuffle for the plan. Slots come from one
range partitioning by (shard, text checksum, size, row), whose last key is unique: a hot text
or shard is cut like any other, and a slot is the place in a partition plus the counts before.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCKS = 4096
#: A hot text is one larger than this part of the smallest new shard.
HOT_PART = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink: all supply is sent, no capacity exceeded, at
    the least total cost. Successive shortest paths with potentials over integer units;
    both sides are shard counts, so the network is small."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones")
    source, sink, nodes = n + m, n + m + 1, n + m + 2
    to, room, price, out = [], [], [], [[] for _ in range(nodes)]

    def edge(u: int, v: int, cap: int, c: int) -> int:
        for a, b, x, y in ((u, v, cap, c), (v, u, 0, -c)):
            out[a].append(len(to))
            to.append(b)
            room.append(x)
            price.append(y)
        return len(to) - 2

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    middle = [[edge(i, n + j, sum(supply), cost[i][j]) for j in range(m)] for i in range(n)]
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential, left = [0] * nodes, sum(supply)
    while left:
        far, via = [None] * nodes, [-1] * nodes
        far[source], queue = 0, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in out[u]:
                v, nd = to[e], d + price[e] + potential[u] - potential[to[e]]
                if room[e] and (far[v] is None or nd < far[v]):
                    far[v], via[v] = nd, e
                    heapq.heappush(queue, (nd, v))
        for v, d in enumerate(far):
            potential[v] += d or 0
        push, v = left, sink
        while v != source:
            push, v = min(push, room[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        left -= push
    return [[room[e ^ 1] for e in row] for row in middle]


def plan_blocks(blocks: list[tuple], capacity: list[int]) -> tuple[dict, list[list[int]]]:
    """New shard of each block. blocks: (key, old shard, bytes); old shards may be more or
    fewer than the new. Returns {key: shard} and the flow it follows."""
    n, m = max((old for _, old, _ in blocks), default=-1) + 1, len(capacity)
    supply = [0] * n
    for _, old, size in blocks:
        supply[old] += size
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
    # What a flow still wants, largest first; a block goes where its old shard owes most.
    owed = [[(-f, j) for j, f in enumerate(row) if f] for row in flow]
    for row in owed:
        heapq.heapify(row)
    placed, load = {}, [0] * m
    for key, old, size in sorted(blocks, key=lambda b: (-b[2], b[1], b[0])):
        want, j = heapq.heappop(owed[old]) if owed[old] else (0, min(old, m - 1))
        heapq.heappush(owed[old], (want + size, j))
        placed[key] = j
        load[j] += size
    return _level(blocks, placed, load, capacity), flow


def _level(blocks: list[tuple], placed: dict, load: list[int], capacity: list[int]) -> dict:
    """Move single blocks from the fullest shard (against its capacity) to the emptiest
    while that brings the two closer."""
    held = defaultdict(list)
    for key, _, size in blocks:
        held[placed[key]].append((size, key))
    for _ in range(4 * len(capacity) * max(1, len(blocks)).bit_length()):
        over = [load[j] - capacity[j] for j in range(len(capacity))]
        a, b = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[a] - over[b]
        best = min((x for x in held[a] if 0 < x[0] < gap), key=lambda x: (abs(gap - 2 * x[0]), x), default=None)
        if best is None:
            break
        held[a].remove(best)
        held[b].append(best)
        placed[best[1]] = b
        load[a] -= best[0]
        load[b] += best[0]
    return placed


def near_equal(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def default_old_shard(old_shards: int) -> Column:
    """The layout to migrate from where rows name none: contiguous runs of blocks."""
    return F.floor(F.col("block") * old_shards / BLOCKS).cast("int")


@common.scoped
def reshard(docs: DataFrame, capacity: list[int] | int, old_shard: Column | None = None, old_shards: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows with their new place, and the block transfers that lead there.

    ``docs`` needs doc_id and text; the row as it came is under ``doc``. ``capacity``:
    bytes of each new shard, or a number of shards of near-equal bytes. ``old_shard``: an
    expression over the row, not null; else contiguous blocks.
    Returns (doc, size, text_crc32, old_shard, shard, slot) and (old_shard, block, hot, part,
    shard, bytes, rows); hot: the hash of a hot text, 0 for what is left of the block. Null
    text is empty, of size 1; repeated rows each take a slot, ties in any order; an empty table
    gives no row.
    """
    spark = docs.sparkSession
    text = common.whole_text()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *([] if old_shard is None else [old_shard.cast("int").alias("old_shard")]),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("block", F.pmod("hash", F.lit(BLOCKS)).cast("int"))
    if old_shard is None:
        rows = rows.withColumn("old_shard", default_old_shard(old_shards))
    rows, _ = common.materialize(rows, "blocks")
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    whole = {(p["old_shard"], p["block"]): (p["bytes"], p["rows"]) for p in rows.groupBy("old_shard", "block").agg(*sums).collect()}
    targets = near_equal(sum(x for x, _ in whole.values()), capacity) if isinstance(capacity, int) else list(capacity)
    limit = max(1, min(targets, default=1) // HOT_PART)
    units = {(*block, 0, 0): x for block, x in whole.items()}
    hot: dict[tuple, int] = {}
    if large := sorted({block for (_, block), (x, _) in whole.items() if x > limit}):
        texts = rows.where(F.col("block").isin(large)).groupBy("old_shard", "block", "hash").agg(*sums).where((F.col("bytes") > limit) & (F.col("rows") > 1))
        hot = {(p["old_shard"], p["block"], p["hash"]): -(-p["bytes"] // limit) for p in texts.collect()}  # HOT_PART a shard at most
    cut = spark.createDataFrame([(*k, n) for k, n in hot.items()], "old_shard int, block int, hash long, parts long")
    rows = rows.join(F.broadcast(cut), ["old_shard", "block", "hash"], "left")
    rows = rows.withColumn("hot", F.when(F.col("parts").isNotNull(), F.col("hash")).otherwise(0)).withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))
    key = ["old_shard", "block", "hot", "part"]
    if hot:
        for p in rows.where("parts IS NOT NULL").groupBy(*key).agg(*sums).collect():
            k, block = tuple(p[c] for c in key), (p["old_shard"], p["block"], 0, 0)
            units[k] = (p["bytes"], p["rows"])
            units[block] = (units[block][0] - p["bytes"], units[block][1] - p["rows"])
        units = {k: x for k, x in units.items() if x[1]}
    placed, _ = plan_blocks([(k, k[0], x) for k, (x, _) in units.items()], targets)
    plan = spark.createDataFrame([(*k, placed[k], *x) for k, x in units.items()], "old_shard int, block int, hot long, part long, shard int, bytes long, rows long")
    moved = rows.join(F.broadcast(plan.select(*key, "shard")), key)
    order = moved.repartitionByRange("shard", "text_crc32", "size", "row").sortWithinPartitions("shard", "text_crc32", "size", "row")
    order = order.select("doc", "size", "text_crc32", "old_shard", "shard", "block", "hot", "part", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    order, _ = common.materialize(order, "order")
    # Of each partition and shard: rows, and the place of the first. A partition holds few shards.
    pieces = sorted(tuple(r) for r in order.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).collect())
    before, starts = defaultdict(int), []
    for shard, piece, n, at in pieces:
        starts.append((shard, piece, before[shard] - at))
        before[shard] += n
    out = order.join(F.broadcast(spark.createDataFrame(starts, "shard int, piece int, first long")), ["shard", "piece"]).withColumn("slot", F.col("first") + F.col("at"))
    return out.select("doc", "size", "text_crc32", "old_shard", "shard", "slot", "block", "hot", "part"), plan


def rewrite(docs: DataFrame, new_shard: Column, old_shard: Column, path: str) -> list[int]:
    """Write the shards that gained or lost a row to ``path``/shard=N and return their
    numbers; the other shards keep their files. ``docs`` may be read from ``path``: touched
    shards are written aside first, then take the place of the old ones, one by one; one that
    lost all its rows goes. A driver lost midway leaves all of that aside: ``recover`` goes on
    from there. Null texts and repeated rows are rows like any other; rows without a new shard
    are an error, since they would be lost; an empty table touches nothing."""
    spark = docs.sparkSession
    recover(spark, path)
    moved = docs.select(old_shard.cast("int").alias("a"), new_shard.cast("int").alias("b")).where("NOT a <=> b").distinct().collect()  # pairs of shards
    if any(r["b"] is None for r in moved):
        raise ValueError("a row has no new shard")
    touched = sorted({int(x) for r in moved for x in (r["a"], r["b"]) if x is not None})
    if not touched:
        return touched
    aside = f"{path}/{ASIDE}{uuid.uuid4().hex}"
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    docs.select(*kept, new_shard.cast("int").alias("shard")).where(F.col("shard").isin(touched)).write.partitionBy("shard").parquet(f"{aside}/new")
    common.make_folder(spark, f"{aside}/old")
    for n in touched:
        common.make_folder(spark, f"{aside}/todo/shard={n}")
    common.make_folder(spark, f"{aside}/{READY}")
    recover(spark, path)
    return touched


#: Folders of a rewrite under way (readers skip names with an underscore), and the mark that all
#: its files are written.
ASIDE, READY = "_rewrite-", "ready"


def recover(spark: SparkSession, path: str) -> None:
    """Finish a rewrite whose files are all written; drop one whose files aren't."""
    for name in common.names_in(spark, path):
        aside = f"{path}/{name}"
        if not name.startswith(ASIDE):
            continue
        for shard in common.names_in(spark, f"{aside}/todo") if common.exists(spark, f"{aside}/{READY}") else []:
            # The old files go aside before the new ones come: what stands in the shard's place,
            # once they have, is new.
            if common.exists(spark, f"{path}/{shard}") and not common.exists(spark, f"{aside}/old/{shard}"):
                common.move(spark, f"{path}/{shard}", f"{aside}/old/{shard}")
            if common.exists(spark, f"{aside}/new/{shard}"):
                common.make_folder(spark, f"{aside}/old/{shard}")
                common.move(spark, f"{aside}/new/{shard}", f"{path}/{shard}")
            common.drop(spark, f"{aside}/todo/{shard}")
        common.drop(spark, aside)


def migrate(spark: SparkSession, path: str, capacity: list[int] | int) -> list[int]:
    """Reshard a folder of shards (``path``/shard=N with doc_id, text and any other columns) to
    new capacities, moving the fewest bytes; returns the shards that were rewritten."""
    recover(spark, path)
    rows = spark.read.parquet(path)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    placed, _ = reshard(rows.select(whole.alias("row"), "text"), capacity, F.col("row.shard"))
    moved = placed.select("doc.row", F.col("shard").alias("new_shard"))
    flat = moved.select(*[F.col(f"row.`{c}`").alias(f"c{k}") for k, c in enumerate(rows.columns) if c != "shard"], F.col("row.shard").alias("old"), "new_shard")
    named = flat.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rows.columns) if c != "shard"], F.struct("old", "new_shard").alias("shard"))
    return rewrite(named, F.col("shard.new_shard"), F.col("shard.old"), path)


def op2_resharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents from five old shards into eight of near-equal bytes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    placed, _ = reshard(docs, shards)
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
