"""Order-aware building blocks that hold when one key owns most rows.

`keep_first` filters `row_number() = 1`, for which Spark plans a partial
window-group limit before the shuffle: a hot key sends one row per map task.

`running` and `ordinal` cut every key into ordered buckets.  Rows are windowed
inside a bucket; bucket totals, far fewer, are accumulated across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key (NULL keys are equal) in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
            sums: dict[str, Column] | None = None,
            firsts: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None,
            totals: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums, first / last non-null values up to each row, and totals of its key.

    `bucket` must not decrease along `order` within a key.  Choose it so that
    a bucket of the hottest key still fits one task.  Rows are moved once: the window
    and the join with the offsets share one key, a struct, in which NULL equals NULL.
    """
    sums, firsts, lasts, totals = sums or {}, firsts or {}, lasts or {}, totals or {}
    at = F.struct(*[F.col(c) for c in order])
    bucketed = df.withColumn("_bucket", bucket)
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()],
        *[F.min_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in firsts.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in lasts.items()],
    )
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    key = F.struct(*keys, "_bucket")
    offsets = per_bucket.select(
        key.alias("_b"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.first(n, ignorenulls=True).over(before).alias(f"_o_{n}") for n in firsts],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_o_{n}") for n in lasts],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*keys)).alias(f"_o_{n}") for n in totals],
    )
    rows = bucketed.withColumn("_bucket", key)
    within = (Window.partitionBy("_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    windowed = rows.select(
        "*",
        *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{n}") for n, c in sums.items()],
        *[F.first(c, ignorenulls=True).over(within).alias(f"_w_{n}") for n, c in firsts.items()],
        *[F.last(c, ignorenulls=True).over(within).alias(f"_w_{n}") for n, c in lasts.items()],
    )
    joined = windowed.join(offsets, windowed["_bucket"] == offsets["_b"])
    return joined.select(
        *[windowed[c] for c in df.columns],
        *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_o_{n}"), F.col(f"_w_{n}")).alias(n) for n in firsts],
        *[F.coalesce(F.col(f"_w_{n}"), F.col(f"_o_{n}")).alias(n) for n in lasts],
        *[F.col(f"_o_{n}").alias(n) for n in totals],
    )


def ordinal(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
            name: str = "ordinal") -> DataFrame:
    """Exact 1-based row number within each key."""
    return running(df, keys, bucket, order, sums={name: F.lit(1).cast("long")})
