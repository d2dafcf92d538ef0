"""Exact duplicates: a fuse filter per bucket of a snapshot screens what comes in.

A snapshot is an immutable table of the distinct texts seen so far, one row per
text, dealt into buckets by the first bits of its SHA-256; every bucket has a
static filter.  Of an incoming batch,

* copies within the batch are grouped on their own, by digest, with partial
  aggregation, so a text that fills a third of the batch sends a row per task;
* the distinct digests meet the filter of their bucket, which knows 8 of their
  bytes; those it may hold are joined with the exact rows of the bucket, where all
  32 bytes, the length of the text and an independent 64-bit hash must agree;
* all other digests are new and never touch the snapshot.

The text is read once and hashed by built-in functions.  It is never shuffled:
comparing the texts themselves would move the whole corpus to confirm what SHA-256,
length and a second hash have established.

Defined results: NULL counts as the empty text; texts are compared after
replacing each run of ASCII white space by one space (not trimmed); rows that
share a doc_id are one document; a NULL doc_id never stays where another row of
the group has an id, and a group of only such rows has keep_id NULL and keeps
its rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm import fuse_filter
from opinia.llm.common import cut, table

#: What must agree for two texts to be the same.
SAME = ["sha", "n_bytes", "check"]
#: Keys that a bucket holds about; with them its filter takes some 10 KB.
BUCKET_KEYS = 8192


@dataclass(frozen=True)
class Snapshot:
    """rows: sha, bucket, keep_id, copies; filters: bucket, filter; buckets: their number."""

    rows: DataFrame
    filters: DataFrame
    buckets: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, seen: Column, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """doc_id, whether it was seen, SHA-256, length and XXH64 of the normalised text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(seen, F.lit(False)).alias("seen"),
                       normalised(F.col(text_column)).alias("body"))
    return rows.select("doc_id", "seen", F.unhex(F.sha2("body", 256)).alias("sha"),
                       F.octet_length("body").alias("n_bytes"), F.xxhash64("body").alias("check"))


def _first_bits(sha: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(sha), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _keys(shas: pd.Series) -> np.ndarray:
    """Bytes 8 to 15 of the digests as 64-bit keys (the bucket uses bytes 0 to 3)."""
    return np.frombuffer(b"".join(bytes(s[8:16]) for s in shas), np.uint64)


def _one_per_text(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy(*SAME).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))


def snapshot(hashed: DataFrame) -> Snapshot:
    """The immutable snapshot of some rows of `digests`, written with its filters."""
    rows = cut(_one_per_text(hashed), "snapshot-rows")
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    rows = rows.withColumn("bucket", _first_bits(F.col("sha"), buckets))

    def filter_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse_filter.build(_keys(part["sha"]))]})

    filters = rows.select("bucket", "sha").groupBy("bucket").applyInPandas(
        filter_of, "bucket int, filter binary")
    return Snapshot(rows, cut(filters, "snapshot-filters"), buckets)


def screen(batch: DataFrame, stored: Snapshot) -> DataFrame:
    """Rows of a batch of distinct digests, with `maybe`: its bucket's filter may hold it."""
    names = [*batch.columns, "bucket", "maybe"]
    held = batch.withColumn("bucket", _first_bits(F.col("sha"), stored.buckets))

    def look_up(part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        stored_filter = filters["filter"].iloc[0] if len(filters) else None
        return part.assign(maybe=fuse_filter.contains(stored_filter, _keys(part["sha"])))[names]

    return held.groupBy("bucket").cogroup(stored.filters.groupBy("bucket")).applyInPandas(
        look_up, held.withColumn("maybe", F.lit(True)).schema)


def exact_dedup(docs: DataFrame, seen: Column, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    `seen` marks the rows that the snapshot already holds; the others come in as
    a new batch.  The smallest doc_id of both stays.
    """
    hashed = cut(digests(docs, seen, id_column, text_column), "digests")
    stored = snapshot(hashed.filter("seen"))
    batch = cut(screen(_one_per_text(hashed.filter(~F.col("seen"))), stored), "screened")
    old = stored.rows.select(*SAME, F.col("keep_id").alias("old_id"), F.col("copies").alias("old_copies"))
    found = cut(batch.filter("maybe").join(old, SAME).select(
        *SAME, F.least("keep_id", "old_id").alias("common_id"),
        (F.col("copies") + F.col("old_copies")).alias("size")), "positives")
    sides = stored.rows.select(*SAME, "keep_id", "copies", F.lit(True).alias("seen")).unionByName(
        batch.select(*SAME, "keep_id", "copies", F.lit(False).alias("seen")))
    groups = sides.join(found, SAME, "left").select(
        *SAME, "seen", F.coalesce("common_id", "keep_id").alias("keep_id"),
        F.coalesce("size", "copies").alias("group_size"))
    return hashed.join(groups, [*SAME, "seen"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def arrived_before(docs: DataFrame, id_column: str = "doc_id") -> Column:
    """The condition that cuts a table at its middle doc_id: older rows, newer rows."""
    middle = docs.agg(F.percentile_approx(id_column, 0.5)).first()[0]
    return F.lit(False) if middle is None else F.col(id_column) <= F.lit(middle)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the older half by doc_id is the snapshot, the newer half comes in."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, arrived_before(docs))


SQL = r"""
WITH hashed AS (
  SELECT doc_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM hashed)
"""
