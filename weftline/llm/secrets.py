"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three patterns. The battery then judges every other run of token
characters (``CANDIDATE``). Its encoding is inferred (hex, base 32, lower-case or
mixed alphanumeric, base 64), which fixes the alphabet of its tests:

* chi-squared: are the characters spread evenly over that alphabet;
* runs: do upper-case letters, lower-case letters and digits alternate as chance would;
* serial correlation: does a character's place in the alphabet say nothing of the next.

Each test is read twice. Against chance: a candidate is random enough if none of the three
statistics lies past ``PASS_Z`` deviations of what its encoding and length lead to expect.
Against running text: how likely text of that length is to come as close to chance, by the
same statistic (its letters repeat, its classes seldom change, its places may follow each
other). The three p-values against text are combined (Stouffer), divided by weights that grow
with length (a short string has little power) and go through the Benjamini-Hochberg step-up
over all candidates of the corpus, at a false-discovery rate of ``FDR``.

Everything is built-in functions, row by row: positions come from splitting a text by a
pattern and adding up lengths. The step-up needs only a histogram of the p-values on
``BINS`` bins, which is all that reaches the driver. Nothing shuffles but that histogram;
hot texts or sources make no difference.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

#: Patterns of the base spans; fixed by the contract. Kinds in the order in which they are listed.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: What the battery judges.
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"

#: A test rejects chance past this many standard deviations (two-sided 0.1 %).
PASS_Z = 3.29
#: Running text: sum of squared and of cubed letter frequencies, how often neighbours change
#: between upper case, lower case and digits at most, and the least correlation that counts as
#: characters following each other.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES, TEXT_SERIAL = 0.065, 0.0055, 0.25, 0.4
FDR = 0.01
#: The histogram: -log10 of the weighted p-value, BINS bins of BIN each.
BIN, BINS = 0.05, 1000
#: Length at which a candidate has weight 1, and the largest weight.
WEIGHT_LENGTH, MAX_WEIGHT = 32, 4

SPANS = "array<struct<start:int,kind:int,end:int>>"
CHUNK = 512


def _sums(xs: Column) -> Column:
    """Sums of the elements before each place, and of all."""
    return F.aggregate(xs, F.array(F.lit(0)), lambda made, x: F.concat(made, F.array(F.get(made, F.size(made) - 1) + x)))


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each place, by chunks: work grows as n times CHUNK."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: _sums(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))

    def joined(chunks: Column) -> Column:
        starts = _sums(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)))
        return let(starts, lambda s: F.flatten(F.transform(chunks, lambda c, k: let(F.get(s, k), lambda before: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + before)))))

    return let(cut, joined)


def _placed(text: Column, pattern: str, kind: str, found: Column) -> Column:
    """(start, kind, end) of each of the matches ``found``, in code points: a match starts
    after the gaps and matches before it."""
    place = F.lit(KINDS.index(kind))
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
    both = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("match")))

    def ends(sizes: Column) -> Column:
        before = let(F.transform(sizes, lambda s: s["gap"] + s["match"]), _running)
        return F.zip_with(before, sizes, lambda b, s: F.struct((b + s["gap"]).alias("start"), place.alias("kind"), (b + s["gap"] + s["match"]).alias("end")))

    return let(both, ends)


def _matched(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of all leftmost matches; null if there is none. A text without a match is
    searched once, any other twice."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, body(found)))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """(start, kind, end) of each leftmost match; of assignments, those of values long enough."""

    def at(found: Column) -> Column:
        placed = _placed(text, pattern, kind, found)
        if kind != "assign":
            return placed
        value = lambda m: F.regexp_extract(m, pattern, 1)
        judged = F.zip_with(placed, found, lambda s, m: F.struct(s.alias("s"), (F.length(value(m)) >= 6).alias("ok")))
        return F.transform(F.filter(judged, lambda x: x["ok"]), lambda x: x["s"])

    return F.coalesce(_matched(text, pattern, at), F.array().cast(SPANS))


def _tokens(text: Column) -> Column:
    """(start, end, token) of each candidate; null if there is none."""
    named = lambda s, m: F.struct(s["start"].alias("start"), s["end"].alias("end"), m.alias("token"))
    return _matched(text, CANDIDATE, lambda found: F.zip_with(_placed(text, CANDIDATE, "random", found), found, named))


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _judged(token: Column) -> Column:
    """(passed, evidence, weight) of a candidate: whether the battery lets it pass as
    random, and -log10 of its p-value against running text before weighting."""
    return let(F.regexp_replace(token, "=+$", ""), lambda core: let(F.filter(F.split(core, ""), lambda c: c != ""), lambda chars: _tests(core, chars)))


def _serial(place: Column, n: Column) -> Column:
    """Lag-one correlation of places in the alphabet, in standard deviations."""

    def centred(own: Column) -> Column:
        spread = _sum(F.transform(own, lambda x: x * x))
        follow = _sum(F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(own, F.lit(2), F.size(own) - 1), lambda x, y: x * y))
        return let(spread, lambda s: F.when(s > 0, follow / s * F.sqrt(n)).otherwise(F.sqrt(n)))

    return let(_sum(place) / n, lambda mean: let(F.transform(place, lambda x: x - mean), centred))


def _tests(core: Column, chars: Column) -> Column:
    n = F.length(core).cast("double")
    hexes, base32, alnum = (core.rlike(x) for x in ("^([0-9a-f]+|[0-9A-F]+)$", "^[A-Z2-7]+$", "^([a-z0-9]+|[A-Z0-9]+)$"))

    def by_encoding(*values: float) -> Column:
        return F.when(hexes, values[0]).when(base32, values[1]).when(alnum, values[2]).otherwise(values[3]).cast("double")

    size = by_encoding(16, 32, 36, 64)
    # Chance that neighbours differ in class, from the digits and letters of each alphabet.
    change = by_encoding(2 * 10 * 6 / 16**2, 2 * 26 * 6 / 32**2, 2 * 26 * 10 / 36**2, 1 - (2 * 26**2 + 10**2) / 62**2)
    squares = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(core, c, F.lit(""))), F.lit(2.0))))
    letters = F.regexp_replace(core, "[-+/_]", "")
    changes = F.size(F.regexp_extract_all(letters, F.lit("[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))) - 1.0
    place = F.transform(chars, lambda c: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"), c).cast("double"))
    seen = F.struct(n.alias("n"), size.alias("size"), change.alias("change"), squares.alias("squares"), F.greatest(F.length(letters) - 1.0, F.lit(1.0)).alias("pairs"), changes.alias("changes"), let(place, lambda p: _serial(p, n)).alias("serial"))
    return let(seen, _verdict)


def _verdict(s: Column) -> Column:
    n, size, change, squares, pairs, changes = (s[c] for c in ("n", "size", "change", "squares", "pairs", "changes"))
    chi = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1))
    runs = (changes - pairs * change) / F.sqrt(1.25 * pairs * change * (1 - change))
    # The same statistics, in deviations of running text: chi-squared is linear in the share of
    # equal pairs of characters, runs in the share of changes.
    repeats = (squares - n) / (n * (n - 1))
    text_chi = (TEXT_SQUARES - repeats) / F.sqrt(4 / n * (TEXT_CUBES - TEXT_SQUARES**2) + 2 / (n * n) * TEXT_SQUARES)
    text_runs = (changes / pairs - TEXT_CHANGES) / F.sqrt(TEXT_CHANGES * (1 - TEXT_CHANGES) / pairs)
    text_serial = TEXT_SERIAL * F.sqrt(n) - F.abs(s["serial"])
    tail = let((text_chi + text_runs + text_serial) / math.sqrt(3), lambda z: F.when(z > 0.5, (z * z / 2 + F.log(z * math.sqrt(2 * math.pi))) / math.log(10)).otherwise(0.0))  # the bound of Mills
    passed = (F.abs(chi) < PASS_Z) & (F.abs(runs) < PASS_Z) & (F.abs(s["serial"]) < PASS_Z)
    return F.struct(passed.alias("passed"), F.greatest(tail, F.lit(0.0)).alias("evidence"), F.least(n / WEIGHT_LENGTH, F.lit(float(MAX_WEIGHT))).alias("weight"))


def _step_up(tested: DataFrame) -> float:
    """The least weighted evidence that is a discovery; more than any if none is."""
    score = F.col("c.judged.evidence") + F.log10("c.judged.weight")
    rows = (
        tested.select(F.explode("candidates").alias("c"))
        .groupBy(F.when(F.col("c.judged.passed"), F.least(F.floor(F.greatest(score, F.lit(0.0)) / BIN), F.lit(BINS))).otherwise(-1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c.judged.weight").alias("w"))
        .collect()
    )  # BINS + 2 rows at most
    total, found, least = sum(r["w"] for r in rows), 0, float(BINS + 1)
    for r in sorted((r for r in rows if r["bin"] >= 0), key=lambda r: -r["bin"]):
        found += r["n"]
        if 10 ** (-r["bin"] * BIN) <= found * FDR / total:
            least = r["bin"] * BIN
    return least


@common.scoped
def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc, base, spans): the row as it came (without its text unless ``keep_text``), its
    base spans and all its spans, each (start, kind, end) in code points, in order.

    Null text is empty; it and empty texts have no span. Repeated rows each return.
    """
    docs, text = common.spread(docs), common.whole_text()
    kept = [c for c in docs.columns if keep_text or c != "text"]
    base = F.array_sort(F.concat(_spans(text, ASSIGN, "assign"), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text.alias("text"), base.alias("base"))
    rows = rows.select("doc", "base", F.filter(_tokens(F.col("text")), lambda c: ~_overlaps(F.col("base"), c["start"], c["end"])).alias("tokens"))
    judged = F.transform("tokens", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _judged(c["token"]).alias("judged")))
    tested, _ = common.materialize(rows.select("doc", "base", judged.alias("candidates")), "tested")
    least = _step_up(tested)
    random = F.filter("candidates", lambda c: c["judged"]["passed"] & (c["judged"]["evidence"] + F.log10(c["judged"]["weight"]) >= least))
    added = F.transform(F.coalesce(random, F.array()), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return tested.select("doc", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans by one. A column
    n_chars, if there is one, follows the text. Other rows return as they came, null texts and
    repeated rows too, and other columns whatever their names; an empty table stays empty."""
    found = scan(docs, keep_text=True)
    text, spans = F.col("doc.text"), F.col("spans")
    # What stands before each span and after the furthest end of those before it.
    parts = F.aggregate(
        spans,
        F.struct(F.lit("").alias("made"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] < a["at"], a["made"]).otherwise(F.concat(a["made"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("made"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["made"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    rows = found.select("doc", F.when(F.size(spans) > 0, parts).otherwise(text).alias("new"), (F.size(spans) > 0).alias("changed"))
    out = {"text": F.col("new")} | ({"n_chars": F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("doc.n_chars"))} if "n_chars" in docs.columns else {})
    return rows.select(*[out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc.doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == KINDS.index(kind)
