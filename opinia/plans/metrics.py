"""Metrics over page runs, runs, batches and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.functions.markets import enrich_product, star_label, star_label_rank
from opinia.functions.pages import header_total, product_review_count
from opinia.operators.extract import has_next
from opinia.operators.ranking import ordinal, running

RUN = ["asin", "domain", "star_filter"]
# What tells the captures of one tranche apart, where pages carry it; it sorts by time.
RUN_ID = "run_id"
# Pages of one run that are accumulated in one task.
PAGE_BUCKET = 4096


def run_keys(df: DataFrame) -> list[str]:
    """The columns that name a run: the tranche, and the run's own id where there is one."""
    return [RUN_ID, *RUN] if RUN_ID in df.columns else RUN


def page_runs(extracted: DataFrame, kept: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """One row per captured page, pages without reviews included.

    `kept` holds the reviews left after deduplication and `saved` those that
    were stored (all kept ones in a run that stores nothing).  The announced
    totals are those of the first page so far that showed one.
    """
    keys = run_keys(extracted)
    at = [*keys, "page"]
    counts = _per_page(kept, saved, at)
    pages = extracted.select(
        *at,
        F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6, 2)
        .alias("duration_s"),
        (has_next() & F.col("error").isNull()).alias("next"),
        "error",
        header_total(F.col("header_text")).alias("_header"),
        product_review_count(F.col("jsonld_text"), F.col("rating_count_text")).alias("_product"),
    )
    carried = running(
        pages, keys, F.floor(F.col("page") / PAGE_BUCKET), ["page"],
        firsts={"total_reviews_header": F.col("_header"),
                "product_global_review_count": F.col("_product")},
    ).drop("_header", "_product")
    return (
        _left_on(carried, counts, at)
        .select(*at,
                F.coalesce("reviews_parsed", F.lit(0)).alias("reviews_parsed"),
                F.coalesce("saved", F.lit(0)).alias("saved"),
                "duration_s", "next", "error",
                "total_reviews_header", "product_global_review_count")
    )


def failures(runs: DataFrame) -> DataFrame:
    """Failed pages in their narrow form: no product, filter or totals."""
    return runs.filter(F.col("error").isNotNull()).select(
        "page", F.lit(0).cast("long").alias("reviews_parsed"), F.lit(0).cast("long").alias("saved"),
        "duration_s", F.lit(False).alias("next"), "error")


def page_details(runs: DataFrame) -> DataFrame:
    """Pages that went well, then the failed ones in their narrow form."""
    return runs.filter(F.col("error").isNull()).unionByName(
        failures(runs), allowMissingColumns=True)


def labelled(runs: DataFrame) -> DataFrame:
    """Page runs with their star label and product address."""
    star = F.col("star_filter") if "star_filter" in runs.columns else F.lit(None).cast("string")
    return enrich_product(runs.withColumn("star_label", star_label(star)))


def recap(runs: DataFrame) -> DataFrame:
    """Pages, parsed and saved reviews per product, domain and star label."""
    groups = [c for c in ("asin", "domain", "star_label") if c in runs.columns]
    return runs.groupBy(*groups).agg(
        F.max("page").alias("pages"),
        F.sum("reviews_parsed").alias("reviews_parsed"),
        F.sum("saved").alias("saved"))


def recap_sorted(runs: DataFrame) -> DataFrame:
    """The recap by product and domain, star labels from five to one, then all."""
    return recap(runs).withColumn("star_rank", star_label_rank(F.col("star_label"))).orderBy(
        "asin", F.asc_nulls_last("domain"), "star_rank")


def run_errors(runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """The error messages of a run, one row each (a list could outgrow a row)."""
    return runs.filter(F.col("error").isNotNull()).select(
        *keys, "page",
        F.concat(F.lit("Erreur sur la page "), F.col("page").cast("string"), F.lit(": "),
                 F.col("error")).alias("message"))


def run_stats(runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One row per run.  `total_pages` is the last page that gave reviews.

    A run succeeds even when some of its pages failed.
    """
    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("page"))).alias(name)

    return runs.groupBy(*keys).agg(
        F.sum("saved").alias("total_reviews"),
        F.coalesce(F.max(F.when(F.col("reviews_parsed") > 0, F.col("page"))), F.lit(0))
        .alias("total_pages"),
        F.count("error").alias("error_count"),
        first_known("total_reviews_header"),
        first_known("product_global_review_count"),
        F.lit(True).alias("success"),
    )


def failed_run(asin: Column, message: Column) -> Column:
    """Statistics of a product whose run failed as a whole; the batch goes on."""
    return F.struct(
        asin.alias("asin"), F.lit(0).cast("long").alias("total_reviews"),
        F.lit(0).alias("total_pages"), F.lit(1).cast("long").alias("error_count"),
        F.lit(False).alias("success"), message.alias("message"))


def batch_totals(stats: DataFrame) -> DataFrame:
    """Totals of a batch: reviews, successful runs, 'k/n ok'."""
    return stats.agg(
        F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews"),
        F.count_if(F.col("success")).alias("succeeded"),
        F.count("*").alias("runs"),
    ).withColumn("summary", F.concat(
        F.col("succeeded").cast("string"), F.lit("/"), F.col("runs").cast("string"),
        F.lit(" ok")))


def merged_stats(stats: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Runs merged into one row per key (the whole batch when there is none).

    The announced totals are those of the first run by `order`; a batch over
    several products has none.
    """
    def total(name: str) -> Column:
        value = F.min_by(name, order) if order else F.lit(None).cast("long")
        return value.alias(name)

    return stats.groupBy(*keys).agg(
        F.sum("total_reviews").alias("total_reviews"),
        F.sum("total_pages").alias("total_pages"),
        F.sum("error_count").alias("error_count"),
        F.bool_and(F.col("error_count") == 0).alias("success"),
        total("total_reviews_header"),
        total("product_global_review_count"),
    )


def product_means(reviews: DataFrame) -> DataFrame:
    """Reviews and mean rating per product; an absent rating weighs as zero."""
    return reviews.groupBy("asin").agg(
        F.count("*").alias("reviews"),
        (F.sum(F.coalesce("rating", F.lit(0.0))) / F.count("*")).alias("mean_rating"))


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per product and whole star; a missing rating is its own row."""
    return reviews.groupBy("asin", F.floor("rating").cast("int").alias("stars")).agg(
        F.count("*").alias("reviews"))


def review_timeline(reviews: DataFrame) -> DataFrame:
    """Reviews and mean rating per product and month; undated ones have no month.

    Ratings have at most a few decimals and are summed exactly.
    """
    exact = F.sum(F.col("rating").cast("decimal(10,4)")).cast("double")
    return reviews.groupBy("asin", F.substring("review_date", 1, 7).alias("month")).agg(
        F.count("*").alias("reviews"), (exact / F.count("rating")).alias("mean_rating"))


def completeness(runs: DataFrame, asked_pages: int, keys: list[str] = RUN) -> DataFrame:
    """Whether a run read all pages: the number asked, or up to the last one."""
    seen = F.max(F.when(F.col("reviews_parsed") > 0, F.col("page")))
    return runs.groupBy(*keys).agg(
        F.coalesce(seen.cast("long"), F.count("*")).alias("total_pages"),
        F.max_by("next", "page").alias("last_next"),
    ).withColumn("complete", (F.col("total_pages") == asked_pages)
                 | (F.coalesce(F.col("last_next"), F.lit(True)) == F.lit(False)))


def running_progress(runs: DataFrame, max_pages: int, keys: list[str] = RUN,
                     seq: str = "page", bucket: Column | None = None) -> DataFrame:
    """Percent done after each page: saved against the announced total so far,
    or pages against the pages asked while no total is known.
    """
    known = F.when(F.col("total_reviews_header") > 0, F.col("total_reviews_header"))
    bucket = F.floor(F.col(seq) / PAGE_BUCKET) if bucket is None else bucket
    done = running(runs, keys, bucket, [seq], sums={"saved_so_far": F.col("saved")},
                   lasts={"known_total": known})
    return done.withColumn("percent", percent_done(max_pages))


def percent_done(max_pages: int) -> Column:
    """Of `saved_so_far` against `known_total`, or of `page` against the pages asked; halves round to even."""
    by_reviews = F.col("saved_so_far") / F.col("known_total")
    by_pages = F.col("page") / F.lit(max(1, max_pages))
    share = F.when(F.col("known_total").isNotNull(), by_reviews).otherwise(by_pages)
    percent = F.least(F.lit(100.0), F.bround(share * 100))
    return F.greatest(F.lit(0), percent.cast("int"))


def batch_progress(items: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Items done and percent done after each item of a batch, in order."""
    numbered = ordinal(items, [], bucket, order, "batch_done")
    total = items.agg(F.count("*")).scalar()
    return numbered.withColumn("batch_total", total).withColumn(
        "percent",
        F.least(F.lit(100.0), F.bround(F.col("batch_done") / F.col("batch_total") * 100))
        .cast("int"))


def _per_page(kept: DataFrame, saved: DataFrame | None, at: list[str]) -> DataFrame:
    """Kept and saved reviews per page, in one grouping."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = kept.select(*at, one.alias("k"), (one if saved is None else none).alias("s"))
    if saved is not None:
        rows = rows.unionByName(saved.select(*at, none.alias("k"), one.alias("s")))
    return rows.groupBy(*at).agg(F.sum("k").alias("reviews_parsed"), F.sum("s").alias("saved"))


def _left_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, condition, "left").drop(*[f"_r_{k}" for k in keys])
