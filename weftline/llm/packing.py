"""Sequence packing by best-fit decreasing.

1. Each text becomes ids with an end id; documents longer than a window are cut into full
   windows first, each a sequence of its own, so only the last piece is left to place.
2. Those pieces are dealt by hash into bins of a bounded number of pieces, and each bin is
   packed by best-fit decreasing: a segment tree over remaining capacities finds the
   tightest open window that still holds the piece.

Scale: ids never leave the task that made them (only their lengths and checksums do); a
bin holds about ``bin_pieces`` pieces whatever the input, so the second step takes as many
tasks as the input needs. Dealing by a hash of the row, not of its text or source, keeps
hot groups apart. Dealing costs at most a few part-filled windows for each bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenization

WINDOW = 2048
END_ID = 1
BIN_PIECES = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tightest:
    """Open windows by remaining capacity: a segment tree of counts over 1..size, of which
    ``find(n)`` returns the smallest capacity of at least n with an open window, or 0."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def find(self, least: int) -> int:
        tree, node = self.tree, self.leaves + least
        if tree[node]:
            return least
        while node > 1:  # up to the first right-hand neighbour that holds a window
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:  # and down to its smallest
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece. Longest first, ties in the order given."""
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    tree = Tightest(size)
    window, offset, made = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        room = tree.find(n)
        if room:
            w = open_at[room].pop()
            tree.add(room, -1)
        else:
            w, made, room = made, made + 1, size
        window[k], offset[k] = w, size - room
        if room > n:
            open_at[room - n].append(w)
            tree.add(room - n, 1)
    return window, offset


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    bpe = tokenization.byte_bpe(path)
    for batch in batches:
        row, starts, lengths, sums, totals = [], [], [], [], []
        for k, text in enumerate(batch.column("text")):
            ids = np.array([*bpe.encode(text.as_py()), end_id], dtype="<u4")
            for start in range(0, len(ids), size):
                piece = ids[start : start + size]
                row.append(k)
                starts.append(start)
                lengths.append(len(piece))
                sums.append(zlib.crc32(piece.tobytes()))
                totals.append(len(ids))
        doc_id = batch.column("doc_id").take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


@common.scoped
def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = WINDOW, end_id: int = END_ID, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens (ids in that sequence; its padding is up to ``size``).

    ``docs`` needs doc_id and text; other columns are ignored. Null text is empty and
    gives one piece of the end id; a null doc_id stays null; repeated rows are packed as
    rows of their own; an empty table gives no sequence.
    """
    spark = docs.sparkSession
    common.tune(spark)
    path = tokenizer_path or tokenization.default_path()
    texts = common.spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    cut = texts.mapInArrow(lambda b: _cut(b, path, size, end_id), PIECES)
    pieces, _ = common.materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == size).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(size).cast("long").alias("sequence_tokens")
    )
    rest = pieces.where(F.col("length") < size)
    bins = max(1, -(-rest.count() // bin_pieces))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        lengths = group.column("length").to_numpy()
        window, offset = best_fit_decreasing(lengths, size)
        held = np.bincount(window, weights=lengths).astype("int64")
        made = {"sequence_id": ((key[0].as_py() << 32) + window) * 2, "offset": offset, "sequence_tokens": held[window]}
        return pa.table({c: group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {k: pa.array(v, pa.int64()) for k, v in made.items()})

    placed = (
        rest.withColumn("bin", F.pmod(F.xxhash64("piece"), F.lit(bins)))
        .groupBy("bin")
        .applyInArrow(place, PIECES + ", sequence_id long, offset long, sequence_tokens long")
    )
    return full.unionByName(placed)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 ids."""
    return pack(common.table(spark, sf_dir, "documents"))
