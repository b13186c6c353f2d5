"""The pipeline on planted documents: each stage's decision, and what the last packs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import common, near_copies, simhash, tokenization


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    clean = [prose(rng.randint(60, 200)) for _ in range(150)]
    toxic = [prose(40) + " " + rng.choice(["idiot", "moron", "scum"]) + " " + prose(40) for _ in range(60)]
    items = [prose(30) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    rows += [(1000, clean[0]), (1001, clean[0]), (1002, clean[1] + " zz")]  # copies of 0 and 1
    rows += [(1100, prose(50) + " " + items[0] + " " + prose(50)), (1101, items[1] + " " + prose(50) + " " + items[2])]
    rows += [(1200, prose(60) + " api_key = 'abcdef123456' " + prose(60))]
    rows += [(1300, None), (1301, ""), (None, prose(80))]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 210)) for i in range(210)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), items


def test_stages(spark, planted):
    folder, texts, items = planted
    docs = common.table(spark, folder, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = common.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = set(range(150))
    assert set(kept[0]) == set(texts) - set(range(150, 210))
    # 0 and 1 stay for their copies; the null and the empty text are one group.
    assert set(kept[1]) == set(kept[0]) - {1000, 1001, 1002, 1301}
    assert set(kept[2]) == set(kept[1]) - {1101}
    assert items[0] not in kept[2][1100] and len(kept[2][1100].split()) == 100
    assert all(kept[2][i] == texts[i] for i in clean)
    assert set(kept[3]) == set(kept[2]) and "[SECRET]" in kept[3][1200] and "abcdef123456" not in kept[3][1200]
    assert all(kept[3][i] == texts[i] for i in clean)
    bpe = tokenization.byte_bpe(tokenization.default_path())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).groupBy("doc_id").agg(common.F.sum("length").alias("n"), common.F.max("doc_tokens").alias("total"))
    assert {r["doc_id"]: (r["n"], r["total"]) for r in packed.collect()} == {i: (n, n) for i, t in kept[3].items() for n in [len(bpe.encode(t or "")) + 1]}


def test_run(spark, planted):
    folder, _, _ = planted
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.select("doc_id").distinct().count() == 150 + 1 + 1 + 1 + 1


def test_near_copies_at_the_threshold(spark):
    """Against brute force: pairs around 0.8, beyond four bits, chains and repeated rows."""
    rng = random.Random(3)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[5], "", None, "a b", "A  b"]
    sets = [shingles(t) if t and t.split() else set() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or either and 5 * both >= 4 * either:
                far += (simhash.fingerprint(texts[i] or "") ^ simhash.fingerprint(texts[j] or "")).bit_count() > 4
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert far > 20  # what four bits can't reach directly
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted({root(i) for i in range(len(texts))})


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    """With no min-hash at all, pairs within the distance of fingerprints still meet, and only
    those at 0.8 link: pairs of one text each, and texts of one fingerprint."""
    rng = random.Random(11)
    texts, gone, apart, within = [], set(), 0, 0
    while apart < 5 or within < 25:
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(0, 200, 5), rng.choice([1, 2, 3, 6, 7])):
            other[at] = f"x{rng.randrange(9000)}"
        a, b = (near_copies.shingles(" ".join(w)) for w in (words, other))
        alike = 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
        near = np.bitwise_count((near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).view("u8")).item() <= near_copies.DISTANCE
        if not near or (within if alike else apart) >= 25:
            continue
        within, apart = within + alike, apart + (not alike)
        texts += [" ".join(words), " ".join(other)]
        if alike:
            gone.add(len(texts) - 1)
    monkeypatch.setattr(near_copies, "band_keys", lambda own: np.zeros(0, "u8"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(range(len(texts))) - gone


def test_fingerprint_of_a_set():
    for text in ("", "a", "a b c d e f", "a b c " * 30, " ".join(map(str, range(900)))):
        own = near_copies.shingles(text)
        ones = [sum(int(h) >> b & 1 for h in own) for b in range(64)]
        assert int(near_copies.fingerprint(own)[0]) % (1 << 64) == sum(1 << b for b in range(64) if 2 * ones[b] > len(own))


def test_bucket_is_searched_whole():
    """Members near each other but not near the first or the last of their bucket."""
    sets = [list(range(100)), list(range(200, 300)), list(range(205, 305)), list(range(400, 500)), list(range(210, 310))]
    found = near_copies._forest(pa.table({"fp": [1, 2, 3, 4, 5], "own": sets}))
    assert {frozenset(p) for p in zip(*found.to_pydict().values(), strict=True)} == {frozenset({2, 3}), frozenset({2, 5})}
