"""Quality rules: a log-likelihood ratio of hashed n-grams behind a few base counts.

Two multinomials over `BUCKETS` hashed word unigrams and bigrams are counted, one over
trusted documents (labelled of good quality) and one over the whole raw corpus.  A
document's score is the sum of log(trusted / raw) over its n-grams divided by their
number, so its length does not matter.  Every document is judged by one threshold: the
score that all but `REJECTED` of the trusted documents reach.  A document that was counted
as trusted scores higher for that alone, so half of the trusted ones, by hash of doc_id, are
counted and the threshold is taken from the other half.

Everything is a built-in expression; no Python runs on the way.  A text is split once and
judged inside its row: no n-gram is shuffled but as counts of at most `BUCKETS` buckets,
summed before the shuffle.  The ratios, a table of `BUCKETS` whole numbers, are part of the
plan.  They are kept in micro-nats, so sums are exact in any order, and the threshold comes
from a histogram of scores: the same rows give the same verdicts however they are dealt.

The trusted multinomial is fitted on at most `TRUSTED_ROWS` documents of its half, by hash
order of doc_id; raw counts, threshold and verdicts cover all documents.

Defined results: NULL and empty texts have no words and fail the base rules; a document
without n-grams scores 0; rows that share a doc_id are judged one by one; of several labels
of a doc_id the best counts, and NULL labels count as none; without trusted documents there
is no threshold and the base rules decide alone; an empty table gives no rows.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.functions.text import let
from opinia.llm.common import cut, table

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Labelled documents that the trusted multinomial is fitted on, at most.
TRUSTED_ROWS = 20_000
#: Share of trusted documents that may score below the threshold.
REJECTED = 0.002
#: Added to every count.
SMOOTHING = 1.0
#: Ratios are whole numbers of this part of a nat.
SCALE = 1_000_000
#: Scores of one bin of the histogram, in parts of a nat.
BIN = 1_000
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(parts: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice.

    Windows are compared by a 64-bit hash.  Only texts with a repeated window look for its
    places: whole numbers made of the high part of a hash and the place are sorted, which is
    cheap, and places that share the high part are sorted again by their whole hash.
    """
    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(parts, i + 1), F.get(parts, i + 2))

    def beside(rows: Column, same: Callable[[Column], Column]) -> Column:
        return F.filter(rows, lambda x, k: F.coalesce(same(F.get(rows, k - 1)) == same(x), F.lit(False))
                        | F.coalesce(same(F.get(rows, k + 1)) == same(x), F.lit(False)))

    def covered(hashes: Column) -> Column:
        n = F.size(hashes).cast("long")
        high = lambda h: F.call_function("div", F.call_function("shiftrightunsigned", h, F.lit(2)), n)
        packed = F.sort_array(F.transform(hashes, lambda h, i: high(h) * n + i))
        alike = let(packed, lambda p: F.transform(
            beside(p, lambda x: F.call_function("div", x, n)), lambda x: (x % n).cast("int")))
        placed = let(alike, lambda at: F.sort_array(F.transform(
            at, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i")))))
        return let(placed, lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            beside(s, lambda x: x["h"]), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    windows = F.slice(F.transform(parts, window), 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    return let(windows, lambda all_: F.when(
        F.size(F.array_distinct(all_)) == F.size(all_), F.lit(0)).otherwise(covered(all_)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def ngram_buckets(parts: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word and of every two neighbouring words."""
    single = F.transform(parts, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    double = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                         lambda w, i: F.pmod(F.xxhash64(w, F.get(parts, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, double)


def trusted_ids(labels: DataFrame, counted: bool) -> DataFrame:
    """doc_ids of good quality: the half that is counted, or the half that sets the threshold."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("trusted"))
    half = F.pmod(F.xxhash64("trusted", F.lit("half")), F.lit(2)) == int(counted)
    return ids.filter(half).distinct()


def fit_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """At most so many of the counted half, by hash order."""
    return trusted_ids(labels, True).orderBy(F.xxhash64("trusted"), "trusted").limit(most)


def ratios(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           buckets: int = BUCKETS) -> list[int]:
    """log(trusted / raw) of every bucket in whole parts of a nat; `trusted` is bounded."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), words(F.col(text_column)).alias("parts"))
    marked = rows.join(F.broadcast(trusted), F.col("id") == F.col("trusted"), "left")  # bounded: TRUSTED_ROWS ids
    grams = marked.select(F.col("trusted").isNotNull().alias("good"),
                          F.explode(let(F.col("parts"), lambda p: ngram_buckets(p, buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
    held = {r.bucket: (r.raw, r.good) for r in counts.collect()}  # bounded: one row per bucket
    raw_total, good_total = (sum(v[i] for v in held.values()) + SMOOTHING * buckets for i in (0, 1))
    if not any(good for _, good in held.values()):
        return []

    def ratio(raw: int, good: int) -> int:
        return round(SCALE * math.log((good + SMOOTHING) / good_total * raw_total / (raw + SMOOTHING)))

    return [ratio(*held.get(b, (0, 0))) for b in range(buckets)]


def judged(docs: DataFrame, table_: list[int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base counts and the score (whole parts of a nat) of every row."""
    text = F.col(text_column)

    def counts(parts: Column) -> Column:
        scored = F.lit(0).cast("long")
        if table_:
            known = F.from_json(F.lit(json.dumps(table_, separators=(",", ":"))), "array<bigint>")  # folded once
            scored = let(ngram_buckets(parts, len(table_)), lambda grams: F.when(F.size(grams) > 0, F.floor(
                F.aggregate(grams, F.lit(0).cast("long"), lambda total, b: total + F.get(known, b))
                / F.size(grams)).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(
            F.size(parts).cast("long").alias("n_words"),
            F.aggregate(parts, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
            F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long").alias("n_symbols"),
            repeated_lines(text).cast("long").alias("n_dup_lines"),
            repeated_words(parts).cast("long").alias("n_repeat_words"),
            scored.alias("score"))

    found = docs.select(F.col(id_column).alias("doc_id"), F.inline(F.array(let(words(text), counts))))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def threshold(scored: DataFrame, trusted: DataFrame, rejected: float = REJECTED) -> int | None:
    """The lower edge of the bin below which lie at most the share `rejected` of trusted scores.

    Documents that fail the base rules are left out.  The histogram has one row per bin of
    a thousandth nat, and scores lie between the least and the largest ratio.
    """
    held = scored.filter(~F.col("base_failed")).join(trusted, F.col("doc_id").cast("long") == F.col("trusted"), "left_semi")
    bins = held.groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect()
    allowed, below = rejected * sum(r["count"] for r in bins), 0
    for row in sorted(bins):
        below += row["count"]
        if below > allowed:
            return row["bin"] * BIN
    return None


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  rejected: float = REJECTED) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, score (nats an n-gram), kept."""
    known = ratios(docs, fit_ids(labels), id_column, text_column)
    scored = cut(judged(docs, known, id_column, text_column), "quality")
    limit = threshold(scored, trusted_ids(labels, False), rejected)
    passed = F.lit(True) if limit is None else F.col("score") >= limit
    return scored.select("doc_id", *BASE, "base_failed", (F.col("score") / SCALE).alias("score"),
                         (~F.col("base_failed") & passed).alias("kept"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; trusted ones are those labelled of good quality."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
