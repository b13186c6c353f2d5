"""Token counts through a digest cache.

Content (null as empty; nothing else is normalised, since any change would change the
count) and the tokenizer file are known by SHA-256. Counts already stored for both
digests are joined; only distinct contents without one are encoded, and their counts are
appended to the cache for later runs.

Which contents are misses, and which of those occur more than once, is decided on digests
alone. Two tables of bits carry that to the rows: a row whose digest is not in the first is
stored already; one in the first but not in the second is the only row of its miss and is
encoded where it is read. Only the rest (copies, and what falls on a bit by chance) crosses the
network as text, one row a content and task, to be told exactly.

Scale: a table of bits has ``MOST_BITS`` at most; past that it fills up and more texts cross
the network, no count changes. The last join carries digests and counts only. A content that
a third of all rows share is encoded once, and adaptive skew handling splits its side of the
last join. The cache is append-only Parquet, so a failed run leaves either no batch or a whole
one, and two runs that append the same content do no harm: it is read by digest, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokenization

CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])


#: Bits for each content, and of one table at most (16 MB).
BITS_A_CONTENT, MOST_BITS = 16, 1 << 27


def _stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of this tokenizer, one row for each content."""
    if not common.exists(spark, cache_path):
        return spark.createDataFrame([], CACHE).select("content", "n_tokens")
    found = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version)
    return found.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def _bits(contents: DataFrame) -> list[np.ndarray]:
    """Two tables of bits, powers of two in size, in which ``h`` has set its own: of misses, and
    of what is stored or occurs more than once."""
    own = ~F.col("known"), F.col("known") | (F.col("n") > 1)
    counts = contents.agg(*[F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in own]).first()
    sizes = [1 << min(max(15, (BITS_A_CONTENT * n).bit_length()), MOST_BITS.bit_length() - 1) for n in counts]
    set_ = [F.struct(F.lit(k).alias("table"), (F.pmod("h", F.lit(bits)) + 1).alias("at"), x.alias("on")) for k, (x, bits) in enumerate(zip(own, sizes, strict=True))]  # bitmaps count from 1
    rows = contents.select(F.inline(F.array(*set_))).where("on").groupBy("table", F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    tables = [np.zeros((bits >> 15, 4096), "u1") for bits in sizes]
    for r in rows.collect():  # 4 KB each
        tables[r["table"]][r["part"] - 1] = np.frombuffer(r["bits"], "u1")
    return [t.ravel() for t in tables]


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype("i8") & (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype("u1")) & 1 == 1


@common.scoped
def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of each whole text, under the columns
    ``doc`` (a struct of the row as it came, whatever its names), n_bytes, n_tokens.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows each return. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = common.spread(docs)
    path = tokenizer_path or tokenization.default_path()
    version = tokenization.file_digest(path)
    text = common.whole_text(text_col)
    content = F.unhex(F.sha2(text.cast("binary"), 256))

    @F.pandas_udf(T.LongType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenization.byte_bpe(path)
        for texts in batches:
            yield pd.Series([len(bpe.encode(t)) for t in texts], dtype="int64")

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    keyed, _ = common.materialize(keyed, "keyed")
    stored = _stored(spark, cache_path, version)
    contents = keyed.groupBy("content").agg(F.count(F.lit(1)).alias("n")).join(stored.select("content", F.lit(True).alias("known")), "content", "left").select(F.xxhash64("content").alias("h"), "n", F.col("known").isNotNull().alias("known"))
    contents, _ = common.materialize(contents, "contents")
    tables = spark.sparkContext.broadcast(_bits(contents))

    @F.arrow_udf("int")
    def told(h: pa.Array) -> pa.Array:
        """0: stored. 1: the only row of a miss. 2: to be told exactly."""
        own = h.to_numpy()
        misses, others = tables.value
        return pa.array(_has(misses, own) * (1 + _has(others, own)), pa.int32())

    rows = docs.select(text.alias("text"), content.alias("content")).withColumn("told", told(F.xxhash64("content")))
    again = rows.where("told = 2").groupBy("content").agg(F.first("text").alias("text")).join(stored, "content", "left_anti")
    misses = rows.where("told = 1").select("content", "text").unionByName(again.select("content", "text"))
    misses.select("content", F.lit(version).alias("version"), encoded("text").alias("n_tokens")).write.mode("append").parquet(cache_path)
    counts, _ = common.materialize(_stored(spark, cache_path, version), "counts")  # else the join inherits its grouping and can't split a hot content
    return keyed.join(counts, "content", "left").select("doc", "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024, cache_path: str | None = None) -> DataFrame:
    """Counts of every document. Without a path, the cache starts cold and goes with the query:
    what a run costs then doesn't depend on runs before it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    with common.scope(spark) as returned:
        counted = count_tokens(docs, cache_path or common.own_path(spark, "token-counts"))
        return returned(counted.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
