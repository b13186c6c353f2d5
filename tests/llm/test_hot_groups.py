"""Hot groups are split without losing a row or a link, and what each piece computes is checked
against its definition."""

import random
from collections import Counter
from math import log, log10, pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, near_copies, neighbours, resharding, secrets, simhash, toxicity
from test_operators import brute_components


def test_a_hot_text_is_split_and_no_other(spark):
    texts = ["hot " * 50] * 900 + [f"text {k} " * (1 + k % 7) for k in range(300)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed, plan = resharding.reshard(docs, 8)
    rows = placed.collect()
    sizes = [len(t) + 1 for t in texts]
    load, slots, shards = Counter(), {}, {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        shards.setdefault(texts[r["doc"]["doc_id"]], set()).add(r["shard"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= sum(sizes) / 8 / resharding.HOT_PART
    assert [t for t, s in shards.items() if len(s) > 1] == [texts[0]]
    assert plan.agg(F.sum("rows"), F.sum("bytes")).first()[:] == (len(texts), sum(sizes))


@pytest.fixture
def layout(spark, tmp_path):
    path = str(tmp_path / "layout")
    rng = random.Random(2)
    rows = [(k, None if k == 9 else "word " * rng.randint(0, 60), "s", k % 3) for k in range(400)]
    spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, score string, shard int").write.partitionBy("shard").parquet(path)
    return path


def held(spark, path):
    return sorted(((r["doc_id"], r["text"] or "", r["score"]) for r in spark.read.parquet(path).collect()))


def test_migrate(spark, layout):
    before = held(spark, layout)
    touched = resharding.migrate(spark, layout, 5)
    assert held(spark, layout) == before and {3, 4} <= set(touched)
    sizes = spark.read.parquet(layout).groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).collect()
    assert len(sizes) == 5 and max(r["n"] for r in sizes) - min(r["n"] for r in sizes) <= 400
    assert resharding.migrate(spark, layout, [10**6, 10**6, 0, 0, 0]) and {r["shard"] for r in spark.read.parquet(layout).select("shard").distinct().collect()} <= {0, 1}
    assert held(spark, layout) == before


@pytest.mark.parametrize("moves", range(6))
def test_a_rewrite_goes_on_where_it_was_interrupted(spark, layout, monkeypatch, moves):
    """The driver is lost after any number of renames."""
    before, real, done = held(spark, layout), common.move, []

    def failing(*args):
        if len(done) == moves:
            raise OSError("lost")
        done.append(args)
        real(*args)

    new = F.when(F.col("shard") == 0, 1).otherwise(3)
    monkeypatch.setattr(common, "move", failing)
    docs = spark.read.parquet(layout)
    try:
        resharding.rewrite(docs, new, F.col("shard"), layout)
    except OSError:
        pass
    monkeypatch.setattr(common, "move", real)
    resharding.recover(spark, layout)
    assert held(spark, layout) == before
    assert sorted(r["shard"] for r in spark.read.parquet(layout).select("shard").distinct().collect()) == [1, 3]
    with pytest.raises(ValueError):
        resharding.rewrite(spark.read.parquet(layout), F.lit(None).cast("int"), F.col("shard"), layout)


def test_large_buckets_of_fingerprints_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = sorted({centre, *(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(1, 12))) for _ in range(400)), *(rng.getrandbits(64) for _ in range(50))})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    nodes = df.select("fp", F.col("fp").alias("id"))
    found = {r["fp"] % (1 << 64): r["component"] for r in simhash.components(nodes, simhash.links(df, len(fps))).collect()}
    want = brute_components(fps)
    groups, own = {}, {}
    for f, t in zip(fps, want, strict=True):
        groups.setdefault(t, set()).add(f)
        own.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_components_of_stars_and_chains(spark):
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(400, 440)] + [(500, 501), (501, 299)]
    nodes = spark.createDataFrame([(k, k) for k in range(600)], "fp long, id long")
    got = {r["fp"]: r["component"] for r in simhash.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(300), 500, 501]} | {k: 400 for k in range(400, 441)}


def test_large_buckets_of_sketches_lose_no_link(spark, monkeypatch):
    """Texts that share most words in a bucket, in cells of two: groups as by brute force."""
    monkeypatch.setattr(near_copies, "CELL", 2)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(40):
        own = base[:]
        for at in rng.sample(range(200), k % 5):
            own[at] = f"x{k}-{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(docs).collect()) == sorted({top(k) for k in range(len(texts))})


def test_narrow_cells_change_no_answer(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(400, 6)).tolist())], "vec_id long, embedding array<double>")
    found = lambda: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 12)) for r in neighbours.search(df, window=120).collect())
    want = found()
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "CELL", 32)
    assert found() == want


def test_terms_that_tell_only_together():
    """Both terms are as frequent among clean rows; only the pair is not."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(1200):
        own = {1, 2} if k % 6 == 0 else {1} if k % 6 < 2 else {2} if k % 6 < 3 else set()
        rows.append(np.array(sorted(own | {*(10 + rng.integers(0, 500, 8)).tolist()}), "i4"))
        labels.append(int(k % 6 == 0))
    y = np.array(labels)
    index = toxicity.select_terms(rows, y)
    assert {1, 2} <= set(index)
    machine = toxicity.fit(rows, labels, y.mean())
    raw = lambda own: machine.bias + machine.linear[own].sum() + 0.5 * ((machine.factors[own].sum(axis=0) ** 2).sum() - (machine.factors[own] ** 2).sum())
    a, b = index[1], index[2]
    assert raw([a, b]) > 0 > max(raw([a]), raw([b]), raw([]))


def test_pairs_enter_where_terms_do_not():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for k in range(3000):
        toxic = k % 10 == 0
        own = ({1, 2} if k % 30 == 0 else set()) if toxic else {1} if k % 3 == 1 else {2} if k % 3 == 2 else set()
        rows.append(np.array(sorted(own | {*(10 + rng.integers(0, 300, 5)).tolist()}), "i4"))
        y.append(int(toxic))
    y = np.array(y)
    some = np.array([1, 2])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    for t in some:
        has = np.array([t in r for r in rows])
        assert abs(toxicity._z((has & (y == 1)).sum(), (has & (y == 0)).sum(), n1, n0)) < toxicity.LEAST_Z
    assert {1, 2} <= set(toxicity.select_terms(rows, y))


# --- the battery


ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"


def brute_verdict(token):
    import re

    core = token.rstrip("=")
    n = len(core)
    kinds = [("^([0-9a-f]+|[0-9A-F]+)$", 16, 120 / 256), ("^[A-Z2-7]+$", 32, 312 / 1024), ("^([a-z0-9]+|[A-Z0-9]+)$", 36, 520 / 1296), ("", 64, 1 - (2 * 26**2 + 100) / 62**2)]
    size, change = next((s, c) for x, s, c in kinds if re.search(x, core))
    squares = sum(c * c for c in Counter(core).values())
    chi = (size * squares / n - n - (size - 1)) / sqrt(2 * (size - 1))
    letters = re.sub("[-+/_]", "", core)
    pairs, changes = max(1, len(letters) - 1), len(re.findall("[a-z]+|[A-Z]+|[0-9]+", letters)) - 1
    runs = (changes - pairs * change) / sqrt(1.25 * pairs * change * (1 - change))
    place = [ALPHABET.index(c) + 1 for c in core]
    mean = sum(place) / n
    spread = sum((x - mean) ** 2 for x in place)
    serial = sqrt(n) * (sum((x - mean) * (y - mean) for x, y in zip(place, place[1:])) / spread if spread else 1)
    s2, s3 = secrets.TEXT_SQUARES, secrets.TEXT_CUBES
    text = [
        (s2 - (squares - n) / (n * (n - 1))) / sqrt(4 / n * (s3 - s2 * s2) + 2 / n / n * s2),
        (changes / pairs - secrets.TEXT_CHANGES) / sqrt(secrets.TEXT_CHANGES * (1 - secrets.TEXT_CHANGES) / pairs),
        secrets.TEXT_SERIAL * sqrt(n) - abs(serial),
    ]
    z = sum(text) / sqrt(3)
    evidence = max(0.0, (z * z / 2 + log(z * sqrt(2 * pi))) / log(10)) if z > 0.5 else 0.0
    return max(abs(chi), abs(runs), abs(serial)) < secrets.PASS_Z, evidence, min(n / secrets.WEIGHT_LENGTH, secrets.MAX_WEIGHT)


def tokens():
    rng = random.Random(5)
    out = ["a" * 20, "abcdefghijklmnopqrst", "internationalization-of-words", "AAAAAAAAAAAAAAAAAAAAAAAA", "0" * 16, "path/to/some/other/file", "1234567890123456"]
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:36], ALPHABET[:62], ALPHABET[:64]):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.choice([16, 20, 32, 64]))) for _ in range(12)]
    return [*out, *(t + "==" for t in out[-3:])]


def test_the_battery_by_its_definition(spark):
    df = spark.createDataFrame([(t,) for t in tokens()], "t string")
    for r in df.select("t", secrets._judged(F.col("t")).alias("j")).collect():
        passed, evidence, weight = brute_verdict(r["t"])
        assert (r["j"]["passed"], r["j"]["evidence"], r["j"]["weight"]) == (passed, pytest.approx(evidence, abs=1e-9), pytest.approx(weight)), r["t"]


def test_the_step_up_by_its_definition(spark):
    """All spans of a small corpus: Benjamini-Hochberg over every candidate, p-values in bins."""
    rng = random.Random(6)
    texts = [" ".join(rng.sample(tokens(), 4) + ["plain words between"]) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(docs).collect()
    import re

    judged = []
    for r in rows:
        for m in re.finditer(secrets.CANDIDATE, texts[r["doc"]["doc_id"]]):
            if not any(s["start"] < m.end() and m.start() < s["end"] for s in r["base"]):
                judged.append((r["doc"]["doc_id"], m.start(), m.end(), *brute_verdict(m[0])))
    total = sum(j[5] for j in judged)
    score = lambda j: j[4] + log10(j[5])
    passed = sorted((j for j in judged if j[3]), key=score, reverse=True)
    least = None
    for j in passed:
        b = int(min(max(score(j), 0.0) / secrets.BIN, secrets.BINS))
        found = sum(int(min(max(score(k), 0.0) / secrets.BIN, secrets.BINS)) >= b for k in passed)
        if 10 ** (-b * secrets.BIN) <= found * secrets.FDR / total:
            least = b * secrets.BIN
    want = {j[:3] for j in passed if least is not None and score(j) >= least}
    assert want and {(r["doc"]["doc_id"], s["start"], s["end"]) for r in rows for s in r["spans"] if s["kind"] == 3} == want
