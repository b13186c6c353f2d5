"""Language-model scores from a small causal self-attention model, trained in numpy.

The text that is scored is the contract's token sequence: words of the text with A-Z in
lower case, then an end. Each word (with a space before it) becomes subword ids of a
byte-level BPE file. The probability of a subword is that of its class given what came
before, times that of the subword within its class:

    logits(class | x_1..x_i) = log-share of each class after x_i, counted over the corpus
                               + W_o . sum_j softmax_j(q(x_i) . k(x_j) + r(i - j)) v(x_j)

so the residual stream of a position is what its own subword says of the next, and one head
of causal self-attention adds what the others say. The share of a subword within its class
is counted after the subword before it, leaning on coarser counts. A text is cut into
windows of ``CONTEXT`` subwords that overlap; of each, only the last ``STRIDE`` are scored, so every
subword is scored once, with at least ``CONTEXT - STRIDE`` before it. Windows of many
documents make one batch, under one causal mask.

What is gathered over all training documents: word counts (for the base score), subword
counts (the most frequent have rows), counts of their neighbours (from which k-means makes
the classes), and counts of neighbouring subwords and classes. The weights of attention are
fitted (Adam) on every window of all training documents: the driver makes a start on a few
(``SAMPLE``), from which each task goes on with all of its own in one pass. The weights of a row
are then averaged over tasks in proportion to how often each met the row, those of the output
and the distances in proportion to the ids learnt. A task has ``SHARE`` windows at least, so
steps grow with the corpus, and what it hands on doesn't.

Scale: texts are read once, in a narrow pass that writes their ids (which later passes read,
the last one spelling rare and long words again). Word counts meet by word, summed within each task first. For
the base score, the ``FREQUENT`` most frequent words travel with the scoring task (a bounded
table that covers most tokens) and are found by their ids, unspelt; only the other words of a
document are joined with their counts, by hash, so no vocabulary has to fit anywhere.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import compress, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common, tokenization

IDS = 50_258  # subword ids of the file and, last, the end
END = IDS - 1
#: Subwords with vectors of their own, classes, and the width of the head.
TOKENS, CLASSES, WIDTH = 4096, 64, 16
#: The most frequent subwords that tell as neighbours which subwords share a class.
NEAR = 512
STRIDE = 16
CONTEXT = 2 * STRIDE  # a window is two units
#: Documents on which the driver makes a start at fitting attention, windows of one document
#: at most, and steps of Adam.
SAMPLE, SAMPLE_WINDOWS, STEPS, BATCH, RATE = 3000, 256, 1500, 128, 0.01
#: Windows that a task fits attention on at least (if there are as many), windows of one of its
#: steps, windows in a row within a step, such runs computed together, ids held for drawing, and the
#: rate of its first step. Changes of weights are summed in whole 1 / UNIT, whatever the order.
SHARE, STEP, RUN, TOGETHER, DRAWN, RATE_ALL, UNIT = 1 << 19, 512, 8, 32, 1 << 20, 0.003, 1 << 20
#: The most frequent subwords whose pairs are counted one by one, and the weight of the
#: coarser share in each finer one.
PAIRS, PAIR_WEIGHT, CLASS_WEIGHT = 1024, 10, 20
#: Words whose counts travel with the scoring tasks.
FREQUENT = 200_000
#: Distinct words a task holds, with their subwords and counts, before it hands those on.
HELD = 500_000
#: Windows scored at once.
BLOCKS = 128


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


class Words(dict):
    """A number for each word that was asked for, the subword ids of each, end to end, and
    how often each was counted. Every word is encoded once; word 0 is the end of a document."""

    def __init__(self, path: str):
        self.encode, self.opens = tokenization.byte_bpe(path).encode, _opens(path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[b""] = 0
        self.flat, self.ends, self.counts, self.new = array("H", [END]), array("q", [0, 1]), np.zeros(1, "i8"), []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def numbers(self, docs: list[list[bytes]]) -> np.ndarray:
        """Numbers of the words of documents, one after the other, each with its end."""
        out = []
        for own in docs:
            out.append(np.fromiter(map(self.__getitem__, (*own, b"")), "i8", len(own) + 1))
            if self.new:
                self._take(self.new)
                self.new = []
        return np.concatenate(out)

    def _take(self, new: list[bytes]) -> None:
        """Encode new words, each after a space, in one go: the subwords that open with a
        space tell where each starts. Should one hold a space elsewhere (next to other
        white space), each word is encoded by itself."""
        ids = array("H", self.encode(b" ".join([b"", *new]).decode("utf-8", "replace")))
        at = np.flatnonzero(self.opens[np.frombuffer(ids, "u2")])
        if len(at) != len(new):
            for word in new if len(new) > 1 else ():
                self._take([word])
            if len(new) > 1:
                return
            at = at[:0]
        before = len(self.flat)
        self.flat.extend(ids)
        self.ends.extend((at[1:] + before).tolist())
        self.ends.append(len(self.flat))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subword ids of words, and how many each word has."""
        ends = np.frombuffer(self.ends, "i8")
        start, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        after = np.cumsum(size)
        return np.frombuffer(self.flat, "u2")[np.arange(after[-1]) + np.repeat(start - after + size, size)], size

    def add(self, numbers: np.ndarray) -> None:
        new = np.bincount(numbers, minlength=len(self))
        new[: len(self.counts)] += self.counts
        self.counts = new


def ids_of(docs: list[list[bytes]], path: str) -> list[np.ndarray]:
    """Subword ids of each document's words, and the end."""
    words = Words(path)
    return [words.ids(words.numbers([own]))[0] for own in docs]


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> list[bytes]:
    """The bytes of each id; the end has none."""
    spell = tokenization.byte_bpe(path).spellings()
    return [*spell, *[b""] * (IDS - len(spell))]


@lru_cache(maxsize=2)
def _opens(path: str) -> np.ndarray:
    """Whether an id opens with a space."""
    return np.array([b[:1] == b" " for b in _bytes_of(path)])


def packed(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of each word (where its first stands, and how many) in one number, if there are
    four at most; 0 for longer ones. No two words share another number."""
    out, ids = np.zeros(len(at), "u8"), np.r_[ids, np.zeros(3, ids.dtype)]
    for k in range(4):
        some = ids[at + k].astype("u8")
        some += 1
        some <<= 16 * k
        some *= size > k
        out |= some
    out *= size <= 4
    return out


@dataclass
class Frequent:
    """Log-counts of the words that travel with the scoring tasks, and of the end."""

    logs: dict[bytes, float]
    keys: np.ndarray  # of words that can be packed, in order
    values: np.ndarray  # their log-counts
    slots: np.ndarray  # hash -> place of a key that has it
    end: float
    ends: int

    SLOT_BITS = 20

    @staticmethod
    def of(words: list[bytes], counts: np.ndarray, ends: int, path: str) -> Frequent:
        logs, own = np.log10(counts + 0.5), Words(path)
        ids, size = own.ids(own.numbers([words]))
        keys = packed(ids, np.cumsum(size) - size, size)[:-1]
        keys, first = np.unique(keys, return_index=True)
        keys, values = np.r_[np.zeros(1, "u8"), keys[keys > 0]], np.r_[np.nan, logs[first[keys > 0]]]  # 0 is no word's
        slots = np.zeros(1 << Frequent.SLOT_BITS, "i4")
        slots[Frequent.slot(keys)] = np.arange(len(keys))
        return Frequent(dict(zip(words, logs.tolist(), strict=True)), keys, values, slots, float(np.log10(ends + 0.5)), ends)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - Frequent.SLOT_BITS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The log-count of each key; nan for those that aren't here."""
        place = self.slots[self.slot(keys)]
        missed = np.flatnonzero(self.keys[place] != keys)
        place[missed] = np.minimum(np.searchsorted(self.keys, keys[missed]), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.values[place], np.nan)


# --- classes


def rows_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(top, compact): the ids with a row of their own, and for every id its row (the last for
    all that are rare)."""
    count = count.copy()
    count[END] += 1
    top = np.argsort(-count, kind="stable")[:TOKENS]
    top = top[count[top] > 0]
    compact = np.full(IDS, TOKENS, "i4")
    compact[top] = np.arange(len(top))
    return top, compact


def add_neighbours(near: np.ndarray, d: np.ndarray, compact: np.ndarray) -> None:
    """Count, for each row, which of the first NEAR rows stand one (twice) and two ids after
    it, and before it, within documents that lie end to end."""
    after, before = (side.reshape(-1) for side in near)
    c, ends = compact[d].astype("i8"), d == END
    for lag in (1, 2):
        a, b = c[:-lag], c[lag:]
        both = ~ends[:-lag] & (a < TOKENS) & (b < TOKENS)
        if lag == 2:
            both &= ~ends[1:-1]
        for cells, row, by in ((after, a, b), (before, b, a)):
            some = both & (by < NEAR)
            np.add.at(cells, row[some] * NEAR + by[some], 2 // lag)


def classes(docs: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(compact, cls) of documents in memory."""
    d, near = np.concatenate(docs), np.zeros((2, TOKENS, NEAR), "i8")
    count = np.bincount(d, minlength=IDS)
    add_neighbours(near, d, rows_of(count)[1])
    return classes_of(count, near, seed)


def classes_of(count: np.ndarray, near: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(compact, cls): for every id its row and class. Subwords with alike neighbours, by
    k-means on a low-rank view of their weighted co-occurrence, share a class; rare ones
    share the last."""
    rng = np.random.default_rng(seed)
    top, compact = rows_of(count)
    cls = np.full(IDS, CLASSES - 1, "i4")
    n = len(top)
    if n <= CLASSES - 1:
        cls[top] = np.arange(n)
        return compact, cls
    sides = []
    for pair in near[:, :n].astype("f4") / 2:
        rows, cols = pair.sum(axis=1, keepdims=True) + 1, pair.sum(axis=0, keepdims=True) + 1
        sides.append(np.maximum(0, np.log((pair + 1e-9) * pair.sum().clip(1) / rows / cols).astype("f4")))
    both = np.hstack(sides)
    basis = np.linalg.qr(both @ (both.T @ (both @ rng.normal(size=(both.shape[1], 24)).astype("f4"))))[0]
    view = basis[:, :24] * np.linalg.norm(both.T @ basis, axis=0)
    view /= np.maximum(np.linalg.norm(view, axis=1, keepdims=True), 1e-6)
    weight = np.sqrt(np.maximum(count[top], 1)).astype("f8")
    centres = view[rng.choice(n, CLASSES - 1, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        own = np.argmax(view @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, view * weight[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    cls[top] = own
    return compact, cls


# --- the model


def _room(*sizes: int) -> list[np.ndarray]:
    """Arrays to compute in, again and again, so that loops allocate none of their size."""
    return [np.empty(size, "f4") for size in sizes]


def _shaped(room: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The first places of a room, in that shape."""
    return room[: math.prod(shape)].reshape(shape)


def _taken(table: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """The rows of a table, which are all there, into ``out``."""
    np.take(table, rows, axis=0, out=out, mode="clip")


@dataclass
class Model:
    compact: np.ndarray  # id -> row
    cls: np.ndarray  # id -> class
    within: np.ndarray  # id -> share within its class
    by_class: np.ndarray  # (class before, row) -> share within the class of the row
    pairs: np.ndarray  # (row before, row) -> count, for the PAIRS first rows
    pair_sums: np.ndarray  # (row before, class) -> sum of those counts
    after: np.ndarray  # row -> log share of each class next
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    near: np.ndarray  # by distance

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Windows over the rows of a document: inputs only, the end's row before it."""
        n = -(-len(rows) // STRIDE)
        padded = np.full(CONTEXT - STRIDE + n * STRIDE, self.compact[END], "i4")
        padded[CONTEXT - STRIDE + 1 : CONTEXT - STRIDE + len(rows)] = rows[:-1]
        return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[::STRIDE]

    def bias(self) -> np.ndarray:
        """What the mask and the distance add to each (position, context) pair."""
        back = np.arange(STRIDE)[:, None] + CONTEXT - STRIDE - np.arange(CONTEXT)[None, :]
        return np.where(back >= 0, self.near[np.clip(back, 0, CONTEXT - 1)], np.float32(-1e9)).astype("f4")

    def attend(self, x: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries, keys, values, unnormalised weights, and what they mix."""
        q, k, v = self.query[x[:, CONTEXT - STRIDE :]], self.key[x], self.value[x]
        w = q @ k.transpose(0, 2, 1)
        w += bias
        np.exp(w, out=w)
        mixed = w @ v
        mixed /= w.sum(axis=2, keepdims=True)
        return q, k, v, w, mixed

    def log_within(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log-share of each id within its class: as counted after the id before it, which
        leans on what was counted after that one's class, which leans on all. Each share
        sums to one over a class."""
        row, prev, cls = self.compact[ids], self.compact[before], self.cls[ids]
        share = np.where(row < TOKENS, self.by_class[self.cls[before], row], self.within[ids])
        near, far = np.minimum(prev, PAIRS - 1), np.minimum(row, PAIRS - 1)
        finer = (np.where(row < PAIRS, self.pairs[near, far], 0) + PAIR_WEIGHT * share) / (self.pair_sums[near, cls] + PAIR_WEIGHT)
        return np.log(np.where(prev < PAIRS, finer, share))

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10-probability of each document's ids.

        All documents lie end to end in units of STRIDE, each after a unit of padding, so a
        window is any two units in a row: vectors are gathered once a unit, and windows are
        views. Those that end in padding score nothing.
        """
        ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        start = np.cumsum(sizes) - sizes
        before = np.r_[ids[:1], ids[:-1]]
        before[start] = END
        units = 1 - (-sizes // STRIDE)
        first = (np.cumsum(units) - units + 1) * STRIDE
        place = np.arange(len(ids)) + np.repeat(first - start, sizes)
        rows, cls = np.full(units.sum() * STRIDE, self.compact[END], "i4"), np.full(units.sum() * STRIDE, -1, "i4")
        rows[place], cls[place] = self.compact[before], self.cls[ids]
        logs, bias, last = np.zeros(len(rows), "f4"), self.bias(), len(rows) // STRIDE - 1
        vectors, shares, out = np.hstack([self.query, self.key, self.value]), np.exp(self.after), np.ascontiguousarray(self.out)
        room = _room((BLOCKS + 1) * STRIDE * 3 * WIDTH, BLOCKS * STRIDE * CONTEXT, BLOCKS * STRIDE * WIDTH, *[BLOCKS * STRIDE * CLASSES] * 2)
        for u in range(0, last, BLOCKS):
            part = slice(u * STRIDE, (u + BLOCKS + 1) * STRIDE)
            logs[part][STRIDE:] = self._log_classes(vectors, rows[part], np.maximum(cls[part][STRIDE:], 0), bias, shares, out, room)
        return np.add.reduceat(logs[place].astype("f8") + self.log_within(before, ids), start) / np.log(10)

    def _log_classes(self, vectors: np.ndarray, rows: np.ndarray, cls: np.ndarray, bias: np.ndarray, shares: np.ndarray, out: np.ndarray, room: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each class, at all positions but those of the first unit."""
        n = len(cls) // STRIDE
        v, w, mixed, z, drawn = (_shaped(r, shape) for r, shape in zip(room, ((len(rows), 3 * WIDTH), (n, STRIDE, CONTEXT), (n, STRIDE, WIDTH), *[(n * STRIDE, CLASSES)] * 2), strict=True))
        _taken(vectors, rows, v)
        line, item = v.strides[0], v.itemsize
        view = np.lib.stride_tricks.as_strided
        q = view(v[STRIDE:, :WIDTH], (n, STRIDE, WIDTH), (STRIDE * line, line, item))
        k = view(v[:, WIDTH : 2 * WIDTH], (n, CONTEXT, WIDTH), (STRIDE * line, line, item))
        value = view(v[:, 2 * WIDTH :], (n, CONTEXT, WIDTH), (STRIDE * line, line, item))
        np.matmul(q, k.transpose(0, 2, 1), out=w)
        w += bias
        np.exp(w, out=w)
        np.matmul(w, value, out=mixed)
        flat = mixed.reshape(-1, WIDTH)
        flat /= (w.reshape(-1, CONTEXT) @ np.ones(CONTEXT, "f4"))[:, None]
        np.matmul(flat, out, out=z)
        own = z.ravel()[np.arange(len(cls)) * CLASSES + cls] + self.after.ravel()[rows[STRIDE:] * CLASSES + cls]
        np.exp(z, out=z)
        _taken(shares, rows[STRIDE:], drawn)
        return own - np.log(np.einsum("ij,ij->i", z, drawn))


@dataclass
class Counts:
    """What the model counts: ids, and for pairs of neighbours (row, next class), (class,
    next row) and, among the PAIRS first rows, (row, next row)."""

    ids: np.ndarray
    after: np.ndarray
    by_class: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def empty() -> Counts:
        return Counts(np.zeros(IDS, "i8"), np.zeros((TOKENS + 1) * CLASSES, "i8"), np.zeros(CLASSES * (TOKENS + 1), "i8"), np.zeros(PAIRS * PAIRS, "i8"))

    def parts(self) -> list[np.ndarray]:
        return [self.ids, self.after, self.by_class, self.pairs]

    def add(self, d: np.ndarray, compact: np.ndarray, cls: np.ndarray) -> None:
        """Count documents that lie end to end; the end of one stands before the next."""
        before = np.r_[np.array([END], d.dtype), d[:-1]]
        row, prev = compact[d].astype("i8"), compact[before].astype("i8")
        np.add.at(self.ids, d, 1)
        np.add.at(self.after, prev * CLASSES + cls[d], 1)
        np.add.at(self.by_class, cls[before].astype("i8") * (TOKENS + 1) + row, 1)
        both = (row < PAIRS) & (prev < PAIRS)
        np.add.at(self.pairs, prev[both] * PAIRS + row[both], 1)


def counted_model(compact: np.ndarray, cls: np.ndarray, counts: Counts, seed: int = 0) -> Model:
    """The model before its attention is fitted: shares from the counts, each leaning on
    the coarser one; small random weights."""
    rng = np.random.default_rng(seed)
    size, total = np.bincount(cls, minlength=CLASSES), np.bincount(cls, weights=counts.ids, minlength=CLASSES)
    within = (counts.ids + 0.05) / (total + 0.05 * size)[cls]
    share = (total + 0.5) / (total.sum() + 0.5 * CLASSES)
    after = counts.after.reshape(TOKENS + 1, CLASSES)
    after = np.log((after + 5 * share) / (after.sum(axis=1, keepdims=True) + 5)).astype("f4")
    known = np.flatnonzero(compact < TOKENS)
    row_share, row_cls = np.zeros(TOKENS + 1), np.full(TOKENS + 1, CLASSES - 1)
    row_share[compact[known]], row_cls[compact[known]] = within[known], cls[known]
    of_class = np.zeros((TOKENS + 1, CLASSES))
    of_class[np.arange(TOKENS + 1), row_cls] = 1
    by_class = counts.by_class.reshape(CLASSES, TOKENS + 1)
    by_class = (by_class + CLASS_WEIGHT * row_share) / ((by_class @ of_class)[:, row_cls] + CLASS_WEIGHT)
    pairs = counts.pairs.reshape(PAIRS, PAIRS).astype("f4")

    def small(*shape: int, by: float) -> np.ndarray:
        return rng.normal(0, by, shape).astype("f4")

    rows = TOKENS + 1
    return Model(
        compact=compact, cls=cls, within=within.astype("f4"), by_class=by_class.astype("f4"), pairs=pairs, pair_sums=(pairs @ of_class[:PAIRS]).astype("f4"), after=after,
        query=small(rows, WIDTH, by=0.3), key=small(rows, WIDTH, by=0.3), value=small(rows, WIDTH, by=0.3), out=small(WIDTH, CLASSES, by=0.1), near=np.zeros(CONTEXT, "f4"),
    )


def fit(model: Model, docs: list[np.ndarray], seed: int = 0, steps: int = STEPS) -> Model:
    """Fit queries, keys, values, the output and the distances by Adam, on windows of the
    sampled documents (evenly spread over a long one): the start that tasks go on from."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for d in docs:
        x, n = model.windows(model.compact[d]), -(-len(d) // STRIDE)
        y = np.full(n * STRIDE, -1, "i4")  # nothing to learn after the end
        y[: len(d)] = model.cls[d]
        y = y.reshape(n, STRIDE)
        some = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_WINDOWS)).astype("i8")) if n else np.zeros(0, "i8")
        xs.append(x[some])
        ys.append(y[some])
    x, y = np.concatenate(xs or [np.zeros((0, CONTEXT), "i4")]), np.concatenate(ys or [np.zeros((0, STRIDE), "i4")])
    if not len(x):
        return model
    params = {n: getattr(model, n) for n in ("query", "key", "value", "out", "near")}
    first, second = ({n: np.zeros_like(p) for n, p in params.items()} for _ in range(2))
    back = np.arange(STRIDE)[:, None] + CONTEXT - STRIDE - np.arange(CONTEXT)[None, :]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), BATCH)
        xb, yb = x[some], y[some]
        q, k, v, w, mixed = model.attend(xb, model.bias())
        w /= w.sum(axis=2, keepdims=True)
        own = xb[:, CONTEXT - STRIDE :]
        z = mixed.reshape(-1, WIDTH) @ model.out + model.after[own.ravel()]
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        real = yb.ravel() >= 0
        p[np.arange(len(p)), np.maximum(yb.ravel(), 0)] -= 1
        p *= real[:, None] / real.sum(dtype="f4")
        d_mixed = (p @ model.out.T).reshape(mixed.shape)
        d_w = d_mixed @ v.transpose(0, 2, 1)
        d_s = w * (d_w - (d_w * w).sum(axis=2, keepdims=True))
        grads = {n: np.zeros_like(a) for n, a in params.items()}
        grads["out"] = mixed.reshape(-1, WIDTH).T @ p
        np.add.at(grads["query"], own, d_s @ k)
        np.add.at(grads["key"], xb, d_s.transpose(0, 2, 1) @ q)
        np.add.at(grads["value"], xb, w.transpose(0, 2, 1) @ d_mixed)
        np.add.at(grads["near"], back[back >= 0], d_s.sum(axis=0)[back >= 0])
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for n, a in params.items():
            first[n] = 0.9 * first[n] + 0.1 * grads[n]
            second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
            a -= (rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype("f4")
    return model


class Attention:
    """Attention in the course of being fitted, by Adam, to a stream of documents. They lie
    end to end as in ``Model.scores``; a step takes ``STEP`` windows, in runs of ``RUN`` from
    places drawn at random, and every window is in one step."""

    def __init__(self, model: Model, steps: int, seed: int = 0):
        self.model, self.steps, self.rng = model, steps, np.random.default_rng(seed)
        self.params = [np.hstack([model.query, model.key, model.value]), model.out.copy(), model.near.copy()]
        self.start = [p.copy() for p in self.params]
        self.first, self.second = ([np.zeros_like(p) for p in self.params] for _ in range(2))
        self.shares, self.step = np.exp(model.after), 0
        self.met, self.learnt = np.zeros(TOKENS + 1, "i8"), 0  # how often each row, and how many ids
        self.sums, self.spare = ([np.zeros_like(p) for p in self.params] for _ in range(2))
        self.room: list[np.ndarray] = []  # made when there is something to learn

    def learn(self, d: np.ndarray) -> None:
        """Learn documents that lie end to end, about ``DRAWN`` ids at once."""
        ends = np.flatnonzero(d == END) + 1
        last = np.flatnonzero(np.diff(ends // DRAWN, append=ends[-1:] // DRAWN + 1))
        for own in np.split(d, ends[last[:-1]]):
            self._learn(own)

    def _learn(self, ids: np.ndarray) -> None:
        start = np.r_[0, np.flatnonzero(ids[:-1] == END) + 1]
        sizes = np.diff(start, append=len(ids))
        before = np.r_[ids[:1], ids[:-1]]
        before[start] = END
        units = 1 - (-sizes // STRIDE)
        first = (np.cumsum(units) - units + 1) * STRIDE
        place = np.arange(len(ids)) + np.repeat(first - start, sizes)
        runs = -(-(int(units.sum()) - 1) // RUN)
        rows, cls = np.full((runs * RUN + 1) * STRIDE, self.model.compact[END], "u2"), np.full((runs * RUN + 1) * STRIDE, -1, "i2")
        rows[place], cls[place] = self.model.compact[before], self.model.cls[ids]
        x, y = np.lib.stride_tricks.sliding_window_view(rows, (RUN + 1) * STRIDE)[:: RUN * STRIDE], cls[STRIDE:].reshape(runs, RUN * STRIDE)
        for some in np.array_split(self.rng.permutation(runs), -(-runs * RUN // STEP)):
            real = max(1, np.count_nonzero(y[some] >= 0))
            for total in self.sums:
                total.fill(0)
            for at in range(0, len(some), TOGETHER):
                self.add_gradients(x[some[at : at + TOGETHER]], y[some[at : at + TOGETHER]], self.sums)
            for total in self.sums:
                total /= np.float32(real)
            self._adam(self.sums)
        self.met += np.bincount(rows, minlength=TOKENS + 1)
        self.learnt += len(ids)

    def add_gradients(self, x: np.ndarray, y: np.ndarray, sums: list[np.ndarray]) -> None:
        """Those of the summed loss of classes, by the vectors of each row, the output and the
        distances. ``x``: rows in runs, after a unit of context; ``y``: classes, -1 for none."""
        (vectors, out, _), n, ids = self.params, len(x), (RUN + 1) * STRIDE
        shapes = [*[(n, ids, 3 * WIDTH)] * 3, *[(n, RUN, STRIDE, CONTEXT)] * 2, *[(n, RUN, STRIDE, WIDTH)] * 3, (n, RUN, CONTEXT, WIDTH), *[(n * RUN * STRIDE, CLASSES)] * 2]
        if not self.room or len(self.room[0]) < math.prod(shapes[0]):
            self.room = _room(*map(math.prod, shapes))
        v, g, lying, w, d_s, mixed, d_mixed, d_q, both, p, drawn = map(_shaped, self.room, shapes)
        _taken(vectors, x, v)
        lines = (v.strides[0], STRIDE * v.strides[1], *v.strides[1:])
        view = np.lib.stride_tricks.as_strided
        q = view(v[:, STRIDE:, :WIDTH], (n, RUN, STRIDE, WIDTH), lines)
        k, value = (view(v[:, :, at : at + WIDTH], (n, RUN, CONTEXT, WIDTH), lines) for at in (WIDTH, 2 * WIDTH))
        np.matmul(q, k.swapaxes(2, 3), out=w)
        w += self.bias()
        np.exp(w, out=w)
        np.matmul(w, value, out=mixed)
        flat, d_flat, by = mixed.reshape(-1, WIDTH), d_mixed.reshape(-1, WIDTH), (w.reshape(-1, CONTEXT) @ np.ones(CONTEXT, "f4"))[:, None]
        flat /= by  # as weights are not, where they have CONTEXT columns
        np.matmul(flat, out, out=p)
        np.exp(p, out=p)
        _taken(self.shares, x[:, STRIDE:].ravel(), drawn)
        p *= drawn
        whole, own = p @ np.ones(CLASSES, "f4"), np.flatnonzero(y.ravel() >= 0)
        p.ravel()[own * CLASSES + y.ravel()[own]] -= whole[own]
        part = np.zeros((len(p), 1), "f4")  # p times this is the gradient by logits
        part[own, 0] = 1 / whole[own]
        np.matmul(p, out.T, out=d_flat)
        d_flat *= part
        np.multiply(flat, part, out=d_q.reshape(-1, WIDTH))
        sums[1] += d_q.reshape(-1, WIDTH).T @ p
        d_flat /= by
        np.matmul(d_mixed, value.swapaxes(2, 3), out=d_s)
        d_s -= np.einsum("ij,ij->i", d_flat, flat).reshape(n, RUN, STRIDE, 1)
        d_s *= w
        np.matmul(d_s, k, out=d_q)
        g[:, :STRIDE] = 0
        g[:, STRIDE:, :WIDTH] = d_q.reshape(n, -1, WIDTH)
        for at, left, right in ((WIDTH, d_s, q), (2 * WIDTH, w, d_mixed)):  # a unit is in two windows
            np.matmul(left.swapaxes(2, 3), right, out=both)
            g[:, STRIDE:, at : at + WIDTH] = both[:, :, STRIDE:].reshape(n, -1, WIDTH)
            g[:, :-STRIDE, at : at + WIDTH] += both[:, :, :STRIDE].reshape(n, -1, WIDTH)
        order = np.argsort(x, axis=None, kind="stable")
        rows = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        lying = lying.reshape(-1, 3 * WIDTH)
        _taken(g.reshape(-1, 3 * WIDTH), order, lying)
        sums[0][rows[first]] += np.add.reduceat(lying, first, axis=0)
        back = np.arange(STRIDE)[:, None] + CONTEXT - STRIDE - np.arange(CONTEXT)[None, :]
        by_place = (np.ones(n * RUN, "f4") @ d_s.reshape(n * RUN, -1)).reshape(STRIDE, CONTEXT)
        sums[2] += np.bincount(back[back >= 0], weights=by_place[back >= 0], minlength=CONTEXT).astype("f4")

    def weighed(self) -> list[np.ndarray]:
        """By how much the weights have changed, in whole ``1 / UNIT``, times how often their
        row was met or how many ids were learnt; and these numbers."""
        n = np.array([self.learnt])
        change = (UNIT * (p.astype("f8") - start) for p, start in zip(self.params, self.start, strict=True))
        return [*(np.rint(c * by).astype("i8") for c, by in zip(change, (self.met[:, None], n, n), strict=True)), self.met, n]

    def averaged(self, sums: np.ndarray) -> Model:
        """The model with what ``weighed`` gave, summed over tasks."""
        *change, met, n = np.split(sums, np.cumsum([p.size for p in self.weighed()])[:-1])
        parts = zip(self.start, change, (met[:, None], n, n), strict=True)
        vectors, out, near = ((p + c.reshape(p.shape) / (UNIT * np.maximum(1, by))).astype("f4") for p, c, by in parts)
        query, key, value = (np.ascontiguousarray(v) for v in np.split(vectors, 3, axis=1))
        return replace(self.model, query=query, key=key, value=value, out=out, near=near)

    def bias(self) -> np.ndarray:
        back = np.arange(STRIDE)[:, None] + CONTEXT - STRIDE - np.arange(CONTEXT)[None, :]
        return np.where(back >= 0, self.params[2][np.clip(back, 0, CONTEXT - 1)], np.float32(-1e9)).astype("f4")

    def _adam(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        rate = RATE_ALL * max(0.1, 1 - self.step / (self.steps + 1)) * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p, first, second, spare, g in zip(self.params, self.first, self.second, self.spare, grads, strict=True):
            np.subtract(g, first, out=spare)
            spare *= np.float32(0.1)
            first += spare
            g *= g
            np.subtract(g, second, out=spare)
            spare *= np.float32(0.001)
            second += spare
            np.sqrt(second, out=g)
            g += np.float32(1e-8)
            np.divide(first, g, out=g)
            g *= np.float32(rate)
            p -= g


# --- over the corpus


def _gathered(batches: Iterator[pa.RecordBatch], path: str, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows. Of each document (doc, row, learn, ids). Of the training documents
    (word, cell, n): counts of words and, as cells, of subword ids; summed within the task."""
    words, total = Words(path), np.zeros(IDS, "i8")

    def counted(word: pa.Array, cell: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), doc_type), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.bool_()), pa.nulls(len(n), pa.binary()), word, cell, n], names=GATHERED)

    def flushed() -> pa.RecordBatch:
        n = np.r_[words.counts, np.zeros(len(words) - len(words.counts), "i8")]
        n[0] = 0  # ends are counted as ids
        out = counted(pa.array(compress(words, n), pa.binary()), pa.nulls(np.count_nonzero(n), pa.int64()), pa.array(n[n > 0]))
        words.reset()
        return out

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        docs = [words_of(text.as_py()) for text in batch.column("text")]
        numbers, tokens = words.numbers(docs), np.array([len(own) + 1 for own in docs])
        ids, size = words.ids(numbers)
        learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False), tokens)
        words.add(numbers[learn])
        total += np.bincount(ids[np.repeat(learn, size)], minlength=IDS)
        ends = np.cumsum(size)[np.cumsum(tokens) - 1]
        made = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, 2 * ends].astype("i4")), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), batch.column("learn"), made, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=GATHERED)
        if len(words) >= HELD:
            yield flushed()
    yield flushed()
    some = np.flatnonzero(total)
    yield counted(pa.nulls(len(some), pa.binary()), pa.array(some, pa.int64()), pa.array(total[some], pa.int64()))


def _cells(batches: Iterator[pa.RecordBatch], parts: Callable[[], list[np.ndarray]], add: Callable[[np.ndarray], None]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of all that ``add`` makes of ``parts``, summed within the task."""
    for batch in batches:
        if batch.num_rows:
            add(np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in batch.column("ids")]))
    flat = np.concatenate([p.ravel() for p in parts()])
    some = np.flatnonzero(flat)
    for at in range(0, len(some), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(some[at : at + (1 << 18)], pa.int64()), pa.array(flat[some[at : at + (1 << 18)]], pa.int64())], names=["cell", "n"])


def _near(batches: Iterator[pa.RecordBatch], compact: np.ndarray) -> Iterator[pa.RecordBatch]:
    near = np.zeros((2, TOKENS, NEAR), "i8")
    return _cells(batches, lambda: [near], lambda d: add_neighbours(near, d, compact))


def _counted(batches: Iterator[pa.RecordBatch], compact: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
    counts = Counts.empty()
    return _cells(batches, counts.parts, lambda d: counts.add(d, compact, cls))


def _fitted(batches: Iterator[pa.RecordBatch], model: Model, steps: int) -> Iterator[pa.RecordBatch]:
    own = Attention(model, steps)
    return _cells(batches, own.weighed, own.learn)


def fit_all(model: Model, ids: DataFrame, windows: int) -> Model:
    """Fit attention on all documents of ``ids``, which have about so many windows: each task
    from ``model``, on all of its own."""
    tasks = max(1, min(ids.rdd.getNumPartitions(), windows // SHARE))
    steps, whole = windows // tasks // STEP, Attention(model, 0)
    shared = ids.sparkSession.sparkContext.broadcast(model)
    cells = ids.coalesce(tasks).mapInArrow(lambda b: _fitted(b, shared.value, steps), "cell long, n long")
    return whole.averaged(_summed(cells, sum(p.size for p in whole.weighed())))


def _summed(cells: DataFrame, size: int) -> np.ndarray:
    """All cells, of which there are ``size`` at most."""
    found, flat = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size, "i8")
    flat[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return flat


GATHERED = ["doc", "row", "learn", "ids", "word", "cell", "n"]
SCORED = ["doc", "row", "n_tokens", "part", "known", "score", "rare"]


def _scored(batches: Iterator[pa.RecordBatch], path: str, model: Model, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """For each document: tokens, the part of the base score and of the known tokens that
    the frequent words and the end give, the model's score, and the other words by hash."""
    import xxhash

    spell, edges = _bytes_of(path), _opens(path) | (np.arange(IDS) == END)
    for batch in batches:
        docs = [np.frombuffer(x.as_py(), "<u2") for x in batch.column("ids")]
        if not docs:
            continue
        flat = np.concatenate(docs)
        at = np.flatnonzero(edges[flat])
        size, ends = np.diff(at, append=len(flat)), flat[at] == END
        n = np.diff(np.flatnonzero(ends), prepend=-1)  # words, and the end
        at, size, doc = at[~ends], size[~ends], np.repeat(np.arange(len(docs)), n - 1)
        log = frequent.find(packed(flat, at, size))
        rest = np.isnan(log)
        at, size = at[rest], size[rest]
        after = np.cumsum(size)
        own = flat[np.arange(size.sum()) + np.repeat(at - after + size, size)]
        spelt = b"".join(map(spell.__getitem__, own.tolist())).split()
        log[rest] = np.fromiter(map(frequent.logs.get, spelt, repeat(np.nan)), "f8", len(spelt))
        other = np.isnan(log)
        part = frequent.end + np.bincount(doc[~other], weights=log[~other], minlength=len(docs))
        known = int(frequent.ends > 0) + np.bincount(doc[~other], minlength=len(docs))
        spelt, words, tfs, sizes = compress(spelt, other[rest]), [], [], []
        for many in np.bincount(doc[other], minlength=len(docs)).tolist():
            count = Counter(islice(spelt, many))
            words += count
            tfs += count.values()
            sizes.append(len(count))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), "u8", len(words)).view("i8")
        checks = np.fromiter(map(zlib.crc32, words), "i8", len(words))
        scores, start, held = [], 0, 0
        for k, d in enumerate(docs):  # windows of a bounded number of ids at once
            held += len(d)
            if held > 200_000 or k == len(docs) - 1:
                scores.append(model.scores(docs[start : k + 1]))
                start, held = k + 1, 0
        items = pa.StructArray.from_arrays([pa.array(hashes), pa.array(checks), pa.array(tfs, pa.int64())], names=["h", "check", "tf"])
        rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), items)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(n, pa.int64()), pa.array(part), pa.array(known), pa.array(np.concatenate(scores)), rare], names=SCORED)


def _sample(docs: DataFrame) -> list[str]:
    """About ``SAMPLE`` distinct texts that aren't empty, SAMPLE at most: those whose hash falls
    into as small a share of all hashes as that takes. Only they leave their tasks."""
    texts = docs.select("text", F.xxhash64("text").alias("h")).where("text <> ''")  # nor null
    contents = texts.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = min(1.0, 1.25 * SAMPLE / max(1, contents))
    place = F.shiftrightunsigned("h", 32)
    texts = texts.where(place < int(share * 2**32)).groupBy("h").agg(F.min("text").alias("text"))
    return [r["text"] for r in texts.orderBy(place, "text").limit(SAMPLE).collect()]


def _frequent(words: DataFrame) -> DataFrame:
    """The most frequent words, ``FREQUENT`` at most: those in the upper bins of a histogram
    over log-counts, which is all that is counted to choose them."""
    place = F.floor(F.log2("n") * 16).cast("int")
    sizes = words.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect()  # 16 bins a doubling
    least, held = 1 << 30, 0
    for r in sorted(sizes, key=lambda r: -r["bin"]):
        held += r["words"]
        if held > FREQUENT:
            break
        least = r["bin"]
    return words.where(place >= least).select("word", "n")


@common.scoped
def score(docs: DataFrame, training: Column, tokenizer_path: str | None = None, seed: int = 0) -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score): each row as it came,
    without its text, and its scores. ``training``: a condition on the rows to learn from.

    Null text is empty and scores its end alone; repeated rows count and score each; with
    no training row the base score is that of an empty corpus, and so are the model's shares.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs, path = common.spread(docs), tokenizer_path or tokenization.default_path()
    if len(tokenization.byte_bpe(path).spellings()) >= IDS:
        raise ValueError(f"the model has rows for {IDS - 1} subword ids; {path} has more")
    drawn = ids_of([words_of(t) for t in _sample(docs.where(training))], path)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.monotonically_increasing_id().alias("row"), F.coalesce(training, F.lit(False)).alias("learn"), common.whole_text().alias("text"))
    doc_type = to_arrow_type(rows.schema["doc"].dataType)
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *T._parse_datatype_string("row long, learn boolean, ids binary, word binary, cell long, n long").fields])
    gathered, gathered_path = common.materialize(rows.mapInArrow(lambda b: _gathered(b, path, doc_type), out), "gathered")
    counts, _ = common.materialize(gathered.where("n IS NOT NULL").groupBy("word", "cell").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word IS NOT NULL")
    ids = gathered.where("ids IS NOT NULL AND learn").select("ids")
    total = _summed(counts.where("word IS NULL").select("cell", "n"), IDS)
    compact = rows_of(total)[1]
    near = _summed(ids.mapInArrow(lambda b: _near(b, compact), "cell long, n long"), 2 * TOKENS * NEAR).reshape(2, TOKENS, NEAR)
    compact, cls = classes_of(total, near, seed)
    sizes = [len(p) for p in Counts.empty().parts()]
    flat = _summed(ids.mapInArrow(lambda b: _counted(b, compact, cls), "cell long, n long"), sum(sizes))
    known = Counts(*np.split(flat, np.cumsum(sizes)[:-1]))
    model = fit_all(fit(counted_model(compact, cls, known, seed), drawn, seed), ids, int(total.sum() // STRIDE + total[END]))
    totals, ends = words.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first(), int(known.ids[END])
    train_tokens, distinct = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    top = _frequent(words).toArrow()
    shared = spark.sparkContext.broadcast((model, Frequent.of(top.column("word").to_pylist(), top.column("n").to_numpy(), ends, path)))
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *T._parse_datatype_string("row long, n_tokens long, part double, known long, score double, rare array<struct<h:long,check:long,tf:long>>").fields])
    made, _ = common.materialize(gathered.where("ids IS NOT NULL").select("doc", "row", "ids").mapInArrow(lambda b: _scored(b, path, *shared.value), out), "scored")
    common.drop(spark, gathered_path)
    rare = made.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    hashed = words.select(F.xxhash64("word").alias("h"), F.crc32("word").alias("check"), "n")
    more = rare.join(hashed, ["h", "check"], "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    whole = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * whole
    return made.drop("rare").join(more, "row", "left").select("doc", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt outside the held-out fifth."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, common.fold(parts=5) != 1)
    return found.select("doc.doc_id", (common.fold("doc.doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
