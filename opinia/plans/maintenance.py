"""Rewrites of the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.functions.text import strip_rating_from_title
from opinia.operators.ranking import keep_first


def title_changes() -> Column:
    """Whether cleaning would change the stored title."""
    old = F.coalesce("review_title", F.lit(""))
    return strip_rating_from_title(old) != old


def migrate_titles(df: DataFrame, limit: int | None = None, now: Column | None = None) -> DataFrame:
    """Remove star mentions from stored titles; touch only rows that change.

    `limit` bounds the rows that are processed, the oldest by creation time and
    review id; all other rows come back as they are.  Write the result as a new
    snapshot and swap: a table cannot be overwritten while it is read.
    """
    now = F.current_timestamp() if now is None else now
    changed = df.withColumn("_changed", title_changes())
    if limit:
        oldest = df.orderBy("created_at", "review_id").select("review_id").limit(limit)
        marked = oldest.distinct().select(F.col("review_id").alias("_id"), F.lit(True).alias("_open"))
        changed = changed.join(marked, changed["review_id"].eqNullSafe(marked["_id"]), "left").withColumn(
            "_changed", F.col("_changed") & F.coalesce("_open", F.lit(False))).drop("_id", "_open")
    touched = {"review_title": F.when(F.col("_changed"),
                                      strip_rating_from_title(F.col("review_title")))
               .otherwise(F.col("review_title"))}
    if "updated_at" in df.columns:
        touched["updated_at"] = F.when(F.col("_changed"), now).otherwise(F.col("updated_at"))
    return changed.withColumns(touched).drop("_changed")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table after an upsert by review id: per id the row updated last.

    Of rows updated at the same time the new one stays; a missing time is the
    oldest.  Rows without an id cannot be matched and all stay.  Write the result
    as a new snapshot and swap.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = keep_first(both.filter(F.col("review_id").isNotNull()), ["review_id"],
                        [F.desc_nulls_last("updated_at"), F.desc("_new"), F.asc_nulls_last("asin")])
    return latest.unionByName(both.filter(F.col("review_id").isNull())).drop("_new")


def migration_metrics(df: DataFrame) -> DataFrame:
    """One row: titles scanned, titles that cleaning changes."""
    return df.agg(F.count("*").alias("scanned"), F.count_if(title_changes()).alias("updated"))


def union_runs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several runs, repeats included; columns a run lacks are NULL."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
