"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Items and documents are cut to words alike. An item's windows are its runs of ``n`` words;
an item of fewer words is one window of its own length. Probing every document window
would hash n words at every word of the corpus, so the scan probes anchors instead: an
occurrence of an n-word window covers exactly one document position divisible by
``stride = n - anchor + 1`` at which ``anchor`` words lie inside it. One hash at every
stride-th position, looked up in the hash set of all anchor grams of the benchmark,
therefore misses nothing. Only windows around an anchor that hit are spelled out and
joined with the benchmark's windows, word for word, which verifies them.

Everything is built-in functions. Texts never shuffle: a document goes through as one row
with the few windows to verify; rows with none are done, and one aggregation by row gathers
the verified hits of the others. The hash set travels to the tasks as a table of bits, of
which one in ``BITS_A_GRAM`` is set or fewer; it has ``MOST_BITS`` at most, so what is shipped is
bounded and a very large benchmark only means more windows to verify. The windows are broadcast only
if they are counted and few, in rows and bytes; else they meet by a shuffled join. A passage
that a third of all documents share is a few more rows for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 8
#: Bits of the hash set for each gram, and of one set at most (2 MB).
BITS_A_GRAM, MOST_BITS = 512, 1 << 24
#: Most windows that are broadcast, and most bytes of them.
MAX_SET, MAX_BYTES = 200_000, 32 << 20
#: What lies between words once A-Z are lower-cased, and a word as it stands in the text; fixed by the normalisation.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, in order. Null text has none."""
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _starts(w: Column, length: int, stride: int = 1) -> Column:
    """Word positions 0, stride, ... from which ``length`` words follow."""
    last = F.size(w) - F.lit(length)
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _hash(w: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(window, length, items): each distinct window and the items that have it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    spelled = F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.array_join(F.slice("w", i + 1, length), " "))
    return items.select("item_id", length.alias("length"), F.explode(spelled).alias("window")).groupBy("window", "length").agg(F.collect_set("item_id").alias("items"))


def _hash_set(grams: DataFrame) -> tuple[Column, int]:
    """A table of bits as one constant array of longs, and its size: a gram's hash sets the bit
    at its remainder."""
    bits, enough = 64, min(MOST_BITS, BITS_A_GRAM * grams.count())
    while bits < enough:
        bits *= 2
    at = F.pmod("gram", F.lit(bits))
    cells = grams.groupBy(F.shiftright(at, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(gram, {bits}) % 64 AS INT))")).alias("bits"))
    table = [0] * (bits // 64)
    for r in cells.collect():  # bits / 64 at most
        table[r["cell"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>"), bits


def _windows_to_verify(w: Column, length: int, known: tuple[Column, int]) -> Column:
    """Windows of one length around the anchors that hit."""
    anchor, (table, bits) = (length + 1) // 2, known
    last = F.size(w) - F.lit(length)
    seen = F.transform(_starts(w, anchor, length - anchor + 1), lambda i: F.struct(i.alias("at"), F.pmod(_hash(w, i, anchor), F.lit(bits)).alias("h")))
    found = F.filter(seen, lambda x: F.getbit(F.get(table, F.shiftright(x["h"], 6).cast("int")), x["h"].cast("int").bitwiseAND(F.lit(63))) == 1)
    around = F.transform(found, lambda x: F.sequence(F.greatest(F.lit(0), x["at"] - F.lit(length - anchor)), F.least(x["at"], last)))
    starts = F.when(last >= 0, F.array_distinct(F.flatten(around))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + F.lit(1), F.lit(length)), " ").alias("window"), F.lit(length).alias("length")))


def _probed(docs: DataFrame, windows: DataFrame, keep_text: bool) -> DataFrame:
    """(row, doc, n_words, probes), written out: the windows of each row that are to be verified."""
    kept = [c for c in docs.columns if keep_text or c != "text"]
    rows = common.spread(docs).select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), words(F.col("text")).alias("w"))
    w, probes = F.col("w"), []
    for length in sorted(r["length"] for r in windows.select("length").distinct().collect()):  # n at most
        anchor = (length + 1) // 2
        own = windows.where(F.col("length") == length).select(F.split("window", " ").alias("w"))
        grams = own.select(F.explode(F.transform(_starts(w, anchor), lambda i: _hash(w, i, anchor))).alias("gram")).distinct()  # noqa: B023  used at once
        probes.append(_windows_to_verify(w, length, _hash_set(grams)))
    none = F.array().cast("array<struct<at:int,window:string,length:int>>")
    made = rows.select("row", "doc", F.size("w").cast("long").alias("n_words"), (F.concat(*probes) if probes else none).alias("probes"))
    return common.materialize(made, "probed")[0]


def _verified(probed: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, n_words, n_hit, items, hits) of rows with windows to verify."""
    rows = probed.where(F.size("probes") > 0).select("row", "doc", "n_words", F.explode("probes").alias("probe")).select("row", "doc", "n_words", "probe.at", "probe.window", "probe.length")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= MAX_SET and size["bytes"] <= MAX_BYTES
    hit = rows.join(F.broadcast(windows) if small else windows, ["window", "length"], "left")
    at = F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("length")).alias("until")))
    return (
        hit.groupBy("row")
        .agg(F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(at)).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("doc", "n_words", _merged(F.col("at")).alias("hits"), "items")
        .select("doc", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda t, h: t + h["until"] - h["at"]).alias("n_hit"), "items", "hits")
    )


@common.scoped
def find(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``doc`` (the row as it came, without its text), n_words, n_hit, items (distinct item
    ids) and hits (word ranges [at, until), merged and in order).

    Null and empty texts have no words and no hits. Repeated rows each return. An item
    with a null id marks words but is no item. An empty benchmark hits nothing.
    """
    windows, _ = common.materialize(benchmark_windows(benchmark, n), "windows")
    probed = _probed(docs, windows, False)
    found = _verified(probed, windows)
    nothing = [F.array().cast(found.schema[c].dataType).alias(c) for c in ("items", "hits")]
    return found.unionByName(probed.where(F.size("probes") == 0).select("doc", "n_words", F.lit(0).cast("long").alias("n_hit"), *nothing))


def _merged(ranges: Column) -> Column:
    """Sorted ranges [at, until), those that touch or overlap made one: they open where a
    range starts past the furthest end so far, which the pass carries with it. Only hit
    rows have any, and only the last range made is replaced."""
    start = F.array().cast("array<struct<at:int,until:int>>")

    def add(made: Column, r: Column) -> Column:
        last = F.get(made, F.size(made) - 1)
        apart = (F.size(made) == 0) | (r["at"] > last["until"])
        wider = F.struct(last["at"].alias("at"), F.greatest(last["until"], r["until"]).alias("until"))
        one = F.struct(r["at"].alias("at"), r["until"].alias("until"))
        return F.when(apart, F.concat(made, F.array(one))).otherwise(F.concat(F.slice(made, F.lit(1), F.size(made) - 1), F.array(wider)))

    return F.aggregate(ranges, start, add)


@common.scoped
def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = 2) -> DataFrame:
    """``docs`` without its contaminated rows (windows of ``min_items`` items or more) and,
    in the others, without the words that are hit; each cut word goes with the gap after
    it. A column n_chars, if there is one, follows the text. Rows without a hit are
    returned as they came, null and empty texts too, and other columns whatever their names;
    repeated rows each return; an empty table stays empty."""
    windows, _ = common.materialize(benchmark_windows(benchmark, n), "windows")
    probed = _probed(docs, windows, True)
    clean = probed.where(F.size("probes") == 0).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
    found = _verified(probed, windows).where(F.size("items") < min_items)
    text = F.col("doc.text")
    gaps, own, hits = F.split(text, WORD), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.col("hits")
    parts = found.select("doc", "hits", F.when(F.size(hits) > 0, gaps).alias("gaps"), F.when(F.size(hits) > 0, own).alias("own"))
    kept = F.transform("own", lambda word, i: F.when(F.exists(hits, lambda h: (h["at"] <= i) & (i < h["until"])), F.lit("")).otherwise(F.concat(word, F.get("gaps", i + 1))))
    cut = parts.select("doc", F.when(F.size(hits) > 0, F.concat(F.get("gaps", F.lit(0)), F.array_join(kept, ""))).otherwise(text).alias("new"))
    out = {"text": F.col("new"), "n_chars": F.when(F.col("new").eqNullSafe(text), F.col("doc.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in docs.columns else None}
    return clean.unionByName(cut.select(*[(F.col(f"doc.`{c}`") if out.get(c) is None else out[c]).alias(c) for c in docs.columns]))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, common.table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bl AS (SELECT item_id, w, least(len(w), 8) AS k FROM b WHERE len(w) > 0
), bp AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bl
), win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM bp
), ks AS (SELECT DISTINCT k FROM win
), dp AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k
), dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM dp
), hit AS (SELECT dw.r, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k
), pos AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)
), n AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r
), it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""
