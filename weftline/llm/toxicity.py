"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and their prefixes of ``PREFIXES`` letters, hashed to
``BUCKETS``; the value of a term is 1 if it occurs. The machine scores

    w0 + sum_i w_i + 1/2 * sum_f ((sum_i v_if)^2 - sum_i v_if^2)

so that a pair of terms can count for more than its parts: an insult next to the mention
of a group, say, where neither says much by itself. It is fitted on a bounded, documented
sample of labelled rows (``SAMPLE`` of each label at most, in order of a hash of the id)
by AdaGrad; only terms whose counts on that sample tell the labels apart (a z-score of at
least ``LEAST_Z`` and ``LEAST_DOCS`` rows), by themselves or as one of a pair that occurs
together (``PAIR_Z``), get a weight, so a long clean text gathers no noise.

Scale: training is bounded, so the model (at most ``TERMS`` terms) is too; it travels to
the tasks with the function that scores. Scoring is one narrow pass over whole texts, with
no shuffle; a hot source or text makes no difference. The labels table is reduced to the
sampled ids by two top-N selections before it meets the texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 24
PREFIXES = (4, 5, 6)
#: Labelled rows of either label that the fit may see.
SAMPLE = 4000
TERMS = 8192
LEAST_DOCS, LEAST_Z = 3, 4.0
#: Terms among whose pairs is looked for such as tell only together: the most frequent of label
#: 1 that don't tell by themselves. A pair must do better than the best of about
#: PAIRED * PAIRED / 2 pairs would by chance, and than its terms.
PAIRED, PAIR_Z, PAIR_TERMS = 1500, 8.0, 512
FACTORS, EPOCHS, BATCH, RATE, DECAY = 6, 12, 64, 0.1, 1e-4
REJECT = 0.7
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms_of(word: bytes) -> list[int]:
    """Hashed terms of one word, itself and its prefixes; letters are UTF-8 bytes."""
    letters = word.decode("utf-8", "ignore")
    parts = [b"w" + word, *(b"p" + letters[:k].encode() for k in PREFIXES if len(letters) >= k)]
    return [zlib.crc32(p) % BUCKETS for p in parts]


def words_of(text: str) -> set[bytes]:
    return set(WORD.findall(text.lower().encode("utf-8", "replace")))


@dataclass
class Machine:
    """A fitted machine: term -> row of ``linear`` and ``factors``."""

    index: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self._seen: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def known(self, text: str) -> list[int]:
        """Rows of the terms that occur, each once."""
        seen, found = self._seen, set()
        for word in words_of(text):
            rows = seen.get(word)
            if rows is None:
                if len(seen) > 400_000:
                    seen.clear()
                rows = seen[word] = tuple(r for t in terms_of(word) if (r := self.index.get(t)) is not None)
            if rows:
                found.update(rows)
        return sorted(found)

    def score(self, text: str) -> float:
        rows = self.known(text)
        v = self.factors[rows]
        raw = self.bias + self.linear[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def _z(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Scores of two proportions, of counts among n1 rows of label 1 and n0 of label 0."""
    n1, n0 = max(1, n1), max(1, n0)
    p = (toxic + clean) / (n1 + n0)
    return (toxic / n1 - clean / n0) / np.maximum(1e-12, np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))


def select_terms(rows: list[np.ndarray], labels: np.ndarray, size: int = TERMS) -> dict[int, int]:
    """Terms whose share among the rows of label 1 differs most from that among the rest,
    by the z-score of two proportions; ties go to the smaller term. After them, the terms of
    pairs that differ so though neither term does."""
    if not rows:
        return {}
    terms, place = np.unique(np.concatenate(rows), return_inverse=True)
    toxic = np.repeat(labels == 1, [len(r) for r in rows])
    both, a = np.bincount(place, minlength=len(terms)), np.bincount(place[toxic], minlength=len(terms))
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    z = np.abs(_z(a, both - a, n1, n0))
    found = np.flatnonzero((both >= LEAST_DOCS) & (z >= LEAST_Z))
    chosen = found[np.argsort(-z[found], kind="stable")][:size].tolist()
    rest = np.flatnonzero((a >= LEAST_DOCS) & (z < LEAST_Z))
    chosen += _paired(rows, labels, terms, rest[np.argsort(-a[rest], kind="stable")][:PAIRED], z)[: size - len(chosen)]
    return {int(terms[k]): i for i, k in enumerate(chosen)}


def _paired(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, some: np.ndarray, z: np.ndarray) -> list[int]:
    """Of some terms (places in ``terms``), those of the best pairs, best first."""
    if len(some) < 2:
        return []
    some = np.sort(some)
    has = np.zeros((len(rows), len(some)), "f4")
    for k, own in enumerate(rows):
        has[k, np.isin(terms[some], own, assume_unique=True)] = 1
    ones, zeros = has[labels == 1], has[labels == 0]
    together, apart = ones.T @ ones, zeros.T @ zeros
    score = np.triu(_z(together, apart, len(ones), len(zeros)), 1)
    score[(together < LEAST_DOCS) | (score < 2 * np.maximum(z[some][:, None], z[some]))] = 0
    x, y = np.nonzero(score >= PAIR_Z)
    order = np.argsort(-score[x, y], kind="stable")[: PAIR_TERMS // 2]
    return list(dict.fromkeys(some[np.column_stack([x[order], y[order]]).ravel()].tolist()))


def fit(rows: list[np.ndarray], labels: list[int], prior: float, seed: int = 0) -> Machine:
    """Fit by AdaGrad on the logistic loss. ``prior``: the share of label 1 among all
    labelled rows; rows weigh as if the sample had it. Without rows of both labels the
    machine answers the prior."""
    y = np.array(labels, "int64")
    index = select_terms(rows, y)
    rng = np.random.default_rng(seed)
    n = len(index)
    bias, linear, factors = np.log(prior / (1 - prior)), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
    chosen = np.array(sorted(index), "int64")
    row_of = np.array([index[t] for t in chosen.tolist()], "int64")
    seen = [row_of[np.searchsorted(chosen, terms[np.isin(terms, chosen)])] for terms in rows]
    if not n or not 0 < y.sum() < len(y):
        return Machine({}, float(bias), np.zeros(0), np.zeros((0, FACTORS)))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    weight = np.maximum(weight, 0.2)  # a rare label still teaches
    g0, g1, g2 = 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            d0, d1, d2 = 0.0, np.zeros(n), np.zeros((n, FACTORS))
            some = order[start : start + BATCH]
            for k in some.tolist():
                x = seen[k]
                v = factors[x]
                total = v.sum(axis=0)
                raw = bias + linear[x].sum() + 0.5 * ((total**2).sum() - (v**2).sum())
                d = weight[k] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[k]) / len(some)
                d0 += d
                d1[x] += d
                d2[x] += d * (total - v)
            touched = np.flatnonzero(d1)
            d1[touched] += DECAY * linear[touched]
            d2[touched] += DECAY * factors[touched]
            g0, g1, g2 = g0 + d0 * d0, g1 + d1 * d1, g2 + d2 * d2
            bias -= RATE * d0 / g0**0.5
            linear -= RATE * d1 / np.sqrt(g1)
            factors -= RATE * d2 / np.sqrt(g2)
    return Machine(index, float(bias), linear, factors)


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic): at most ``sample`` ids of each label outside the held-out fold. An
    id labelled twice is toxic if any of its labels is; rows without id or label go."""
    clean = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(common.fold() != 1).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    return clean.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(clean.where("toxic = 0").orderBy(order, "doc_id").limit(sample))


@common.scoped_value
def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0) -> Machine:
    """The machine for ``docs`` (doc_id, text) from ``labels`` (doc_id, toxic), whatever their
    other columns. Null ids have no label; without rows of both labels, or an empty table, the
    machine answers the share of label 1 (0.001 at least, and where there is no label)."""
    common.tune(docs.sparkSession)
    chosen, _ = common.materialize(sample_labels(labels, sample), "labels")

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({h for w in words_of(t.as_py()) for h in terms_of(w)}) for t in texts], pa.list_(pa.int32()))

    # At most 2 x sample ids are broadcast. A repeated id trains once, by the least of its texts.
    named = docs.select(F.col("doc_id").alias("labelled"), common.whole_text().alias("text"))
    texts = named.join(F.broadcast(chosen.withColumnRenamed("doc_id", "labelled")), "labelled").groupBy("labelled").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = texts.select("labelled", "toxic", hashed("text").alias("terms")).toArrow().sort_by("labelled").combine_chunks()
    terms = rows.column("terms").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
    share = labels.where(common.fold() != 1).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    return fit([t.values.to_numpy() for t in terms], rows.column("toxic").to_pylist(), min(0.99, max(0.001, share or 0.0)), seed)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc, score): the row as it came, with its text, and its score from 0 to 1.

    Null and empty texts have no terms and score the bias; repeated rows score alike.
    """
    common.tune(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([machine.score(t.as_py()) for t in texts], pa.float64())

    return common.spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), scored(common.whole_text()).alias("score"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. Other columns, whatever their
    names, stay as they are; null and empty texts score the bias and stay unless that is so
    high; repeated rows go or stay together; an empty table stays empty."""
    kept = score(docs, train(docs, labels)).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt outside the held-out third."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc.doc_id", (common.fold("doc.doc_id") == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
