"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.constants import DEFAULT_MAX_PAGES
from opinia.functions import dates, markets, pages, ratings, text, urls
from opinia.operators import dedup, extract, records
from opinia.plans import crawl, ingest, maintenance, metrics, views
from opinia.sources import csv_blocks, readers, sinks
from opinia.sources.scratch import scratch_path
from opinia.streaming import pages as streams
from workload import derive
from workload.derive import ORD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["l_orderkey", "l_linenumber", "asin"]
REVIEW = ["review_id", "review_title", "review_body", "rating", "review_date",
          "verified_purchase", "helpful_votes", "reviewer_name", "variant"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _scalar(name: str, build, body: bool = False) -> None:
    """A Column function over every derived review block."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derive.raw_reviews(spark, sf_dir, body).select(*KEY, build().alias("value"))

    QUERIES[name] = run


def c(name: str):
    return F.col(name)


# Scalar functions.

@query
def clean_text_docs(spark, sf_dir):
    documents = derive.spread(derive.table(spark, sf_dir, "documents"), "doc_id")
    return documents.select(
        "doc_id", text.clean_text(c("text")).alias("value"))


_scalar("rating_normalize", lambda: ratings.normalize_rating(c("rating")))
_scalar("date_normalize_fr", lambda: dates.normalize_date_fr(c("date")))
_scalar("date_normalize", lambda: dates.normalize_date(c("date")))
_scalar("votes_normalize", lambda: text.normalize_helpful_votes(c("helpful")))
_scalar("verified_flag", lambda: text.normalize_verified_purchase(c("verified")))
_scalar("canonical_review_id",
        lambda: text.canonical_review_id(c("title"), c("body")), body=True)
_scalar("strip_title", lambda: text.strip_rating_from_title(c("title")))
_scalar("sentiment_label", lambda: ratings.sentiment(ratings.normalize_rating(c("rating"))))
_scalar("review_id_from_url", lambda: urls.review_id_from_url(c("id_href")))
_scalar("product_url", lambda: urls.generate_product_url(c("asin"), c("domain")))
_scalar("review_url", lambda: urls.generate_review_url(
    c("asin"), c("l_linenumber"), domain=c("domain"), star_filter=c("star_filter"),
    sort=F.when(c("l_linenumber") > 3, "helpful"),
    language=F.when(c("l_linenumber") < 3, "fr_FR")))
_scalar("market_language", lambda: markets.market_language(c("domain")))
_scalar("market_timezone", lambda: markets.market_timezone(c("domain")))
_scalar("target_domain", lambda: markets.target_domain(
    F.when(c("l_linenumber") == 1, "www.amazon.de"), c("domain"), c("l_linenumber") % 2 == 1))
_scalar("star_code", lambda: markets.star_code(derive.pick(
    ["all", "five", "four", "three", "two", "one", "six"], c("l_linenumber") - 1)))
_scalar("star_label", lambda: markets.star_label(c("star_filter")))
_scalar("review_id_resolve", lambda: records.resolve_review_id(
    c("id_href"), c("title"), c("body")), body=True)


@query
def content_key(spark, sf_dir):
    key = text.content_key(*[c(n) for n in (
        "review_title", "review_body", "reviewer_name", "review_date", "rating", "variant")])
    return derive.typed(spark, sf_dir).select(*KEY, key.alias("value"))


@query
def localized_int(spark, sf_dir):
    key, number = c("l_partkey"), c("l_linenumber")
    gap = (F.when(number % 4 == 0, "\N{NO-BREAK SPACE}")
           .when(number % 4 == 1, "\N{NARROW NO-BREAK SPACE}")
           .when(number % 4 == 2, ".").otherwise(" "))
    shown = F.concat((1 + key % 9).cast("string"), gap,
                     F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" avis"))
    return derive.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", shown.alias("shown")).select(
        "*", text.localized_int(c("shown")).alias("header_form"),
        text.localized_int(c("shown"), nbsp=False).alias("product_form"))


@query
def coerce_defaults(spark, sf_dir):
    raw = derive.raw_reviews(spark, sf_dir, body=False).select(
        *KEY,
        F.when(c("l_returnflag") != "R", c("l_returnflag") == "A").alias("verified_purchase"),
        c("helpful").alias("helpful_votes"),
        c("l_shipdate").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"))
    return records.coerce_defaults(raw).select(
        *KEY, "verified_purchase", "helpful_votes",
        (c("created_at").isNull() | c("updated_at").isNull()).alias("created_missing"))


def _stored(spark, sf_dir) -> DataFrame:
    """Typed records with row ids and times, order columns kept."""
    ship = c("l_shipdate").cast("timestamp")
    return markets.enrich_product(derive.typed(spark, sf_dir)).withColumns({
        "id": c("l_orderkey") * 10 + c("l_linenumber"),
        "created_at": F.timestamp_millis(F.unix_millis(ship) + c("l_linenumber") * 3600000),
        "updated_at": F.timestamp_micros(F.unix_micros(ship) + c("l_suppkey"))})


def _reviews_table(spark, sf_dir) -> DataFrame:
    """The stored table: each review id once, first writer wins."""
    return records.conform(dedup.keep_first(_stored(spark, sf_dir), ["review_id"], ORD))


@query
def record_projection(spark, sf_dir):
    return records.project_record(_stored(spark, sf_dir))


@query
def market_locale_currency(spark, sf_dir):
    both = markets.market_locale_currency(
        c("domain"), F.when(c("l_linenumber") == 1, "nl_NL"))
    return derive.raw_reviews(spark, sf_dir, body=False).select(
        *KEY, both.alias("m")).select(*KEY, "m.*")


@query
def enrich_product(spark, sf_dir):
    return markets.enrich_product(
        derive.raw_reviews(spark, sf_dir, body=False).select(*KEY, "domain"))


@query
def asin_valid(spark, sf_dir):
    code, form = c("code"), c("line_no") % 4
    shown = (F.when(form == 0, code).when(form == 1, F.concat(code, F.lit("\n")))
             .when(form == 2, F.concat(F.substring(code, 2, 9), F.lit("é")))
             .otherwise(F.substring(code, 2, 9)))
    return derive.product_urls(spark, sf_dir).select(
        "line_no", urls.validate_asin(shown).alias("value"))


@query
def parse_review_url(spark, sf_dir):
    return derive.product_urls(spark, sf_dir).select(
        "line_no", urls.parse_reviews_url(c("line")).alias("p")).select("line_no", "p.*")


@query
def parse_product_url(spark, sf_dir):
    return derive.product_urls(spark, sf_dir).select(
        "line_no", urls.parse_product_url(c("line")).alias("p")).select("line_no", "p.*")


# Lists and crawl planning.

@query
def product_list(spark, sf_dir):
    key, code = c("p_partkey"), derive.product_code(c("p_partkey"))
    line = (F.when(key % 5 == 0, code)
            .when(key % 5 == 1, F.concat(F.lit("  "), code, F.lit("\t")))
            .when(key % 5 == 2, F.concat(F.lit("# "), code))
            .when(key % 5 == 3, F.concat(code, F.lit("-"))).otherwise(""))
    lines = derive.table(spark, sf_dir, "part").select(key.alias("line_no"), line.alias("line"))
    valid, bad = readers.product_list(lines)
    return valid.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query
def url_list(spark, sf_dir):
    return readers.url_list(derive.product_urls(spark, sf_dir).drop("code"))


@query
def url_counts(spark, sf_dir):
    return readers.url_counts(derive.product_urls(spark, sf_dir))


@query
def crawl_plan(spark, sf_dir):
    return crawl.crawl_plan(url_list(spark, sf_dir)).select(
        "line_no", "asin", "domain", "star_filter", "star_rank", "page", "page_url")


@query
def plan_gap(spark, sf_dir):
    captured = derive.with_pages(derive.raw_reviews(spark, sf_dir, body=False))
    captured = captured.select("asin", "star_filter", "page").distinct()
    return crawl.plan_gap(crawl.crawl_plan(url_list(spark, sf_dir)), captured).select(
        "line_no", "asin", "star_filter", "page")


@query
def crawl_frontier(spark, sf_dir):
    """How far the links of every run lead over its usable pages; some last links lead back."""
    captured = pages.usable(pages.triage(derive.captured_pages(spark, sf_dir)))
    extracted = extract.extract_pages(captured)
    back = (F.substring("asin", 2, 9).cast("int") % 7 == 0) & (c("page") == 2)
    extracted = extracted.withColumns({
        "next_href": F.when(back, F.lit("/next?pageNumber=1")).otherwise(c("next_href")),
        "next_link": back | c("next_link"), "next_disabled": ~back & c("next_disabled")})
    return crawl.follow_links(crawl.page_links(extracted))


# Pages.

def _marked(name: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derive.marked_pages(spark, sf_dir).select("page_id", build(c("html")).alias("value"))

    QUERIES[name] = run


_marked("page_challenge", pages.is_challenge)
_marked("page_error", pages.is_error)
_marked("page_login", pages.is_login)


@query
def page_triage(spark, sf_dir):
    triaged = pages.triage(derive.marked_pages(spark, sf_dir)).select("page_id", "page_status")
    good = pages.usable(triaged).withColumn("usable", F.lit(True))
    return good.unionByName(pages.rejected(triaged).withColumn("usable", F.lit(False)))


@query
def page_status_counts(spark, sf_dir):
    return pages.status_counts(pages.triage(derive.marked_pages(spark, sf_dir)))


def _signed_out(spark, sf_dir) -> DataFrame:
    captured = derive.captured_pages(spark, sf_dir).withColumn("login", pages.is_login(c("html")))
    # The login test is a page predicate; the account text comes from the extraction.
    text_says = pages.is_signed_out(F.lit(""), c("account_text"))
    return extract.extract_pages(captured).withColumn("signed_out", c("login") | text_says)


@query
def page_signed_out(spark, sf_dir):
    return _signed_out(spark, sf_dir).select("asin", "page", "signed_out")


@query
def signed_out_domains(spark, sf_dir):
    return _signed_out(spark, sf_dir).groupBy("domain").agg(
        F.bool_and("signed_out").alias("all_signed_out"), F.count("*").alias("pages"))


@query
def extract_reviews(spark, sf_dir):
    blocks = extract.explode_blocks(extract.extract_pages(derive.captured_pages(spark, sf_dir)))
    shown = ["title", "body", "rating", "date", "verified", "helpful", "reviewer", "variant"]
    return blocks.select("asin", "page", "pos", "id_href", "matched_selector",
                         *[F.coalesce(n, F.lit("")).alias(n) for n in shown])


@query
def extract_strict(spark, sf_dir):
    extracted = extract.extract_pages(derive.captured_pages(spark, sf_dir))
    blocks = extract.explode_blocks(extracted, strict=True)
    return records.typed_reviews(blocks, strict=True).select(
        "asin", "page", "pos",
        *[F.coalesce(n, F.lit("")).alias(n) if n in ("review_title", "review_body") else c(n)
          for n in REVIEW])


@query
def header_total(spark, sf_dir):
    return extract.extract_pages(derive.captured_pages(spark, sf_dir)).select(
        "asin", "page", pages.header_total(c("header_text")).alias("value"))


@query
def header_total_forms(spark, sf_dir):
    """Every place in which a page may show its total."""
    return extract.extract_pages(derive.header_pages(spark, sf_dir)).select(
        "p_partkey", pages.header_total(c("header_text")).alias("value"))


@query
def product_count(spark, sf_dir):
    return extract.extract_pages(derive.captured_pages(spark, sf_dir)).select(
        "asin", "page",
        pages.product_review_count(c("jsonld_text"), c("rating_count_text")).alias("value"))


@query
def has_next(spark, sf_dir):
    return extract.extract_pages(derive.captured_pages(spark, sf_dir)).select(
        "asin", "page", extract.has_next().alias("has_next"),
        extract.following_url(c("url")).alias("next_url"))


@query
def next_page_url(spark, sf_dir):
    address = F.replace(c("url"), F.lit("page="), F.lit("pageNumber="))
    return derive.table(spark, sf_dir, "pages").select("page_id", address.alias("url")).withColumn(
        "next_url", urls.next_page_url(c("url")))


@query
def extract_fallback(spark, sf_dir):
    """Every block selector of the chain, and pages that none of them matches."""
    extracted = extract.extract_pages(derive.form_pages(spark, sf_dir))
    return extract.explode_blocks(extracted, strict=True).select("p_partkey", "matched_selector", "body")


@query
def has_next_forms(spark, sf_dir):
    return extract.extract_pages(derive.form_pages(spark, sf_dir)).select(
        "p_partkey", extract.has_next().alias("has_next"))


# Records and duplicates.

@query
def valid_reviews(spark, sf_dir):
    return derive.typed(spark, sf_dir).filter(records.is_valid_review()).select(*KEY, "review_id")


@query
def storable_reviews(spark, sf_dir):
    odd = markets.enrich_product(derive.typed(spark, sf_dir)).withColumns({
        "review_title": F.when(c("l_linenumber") == 3, c("review_body"))
        .otherwise(c("review_title")),
        "asin": F.when(c("l_linenumber") != 4, c("asin"))})
    good, bad = records.storable(odd)
    good = good.withColumn("problem", F.lit(None).cast("string"))
    return good.unionByName(bad).select("l_orderkey", "l_linenumber", "review_id", "problem")


@query
def dedup_page_id(spark, sf_dir):
    return dedup.dedup_page_id(derive.paged(spark, sf_dir), ["asin"]).select(
        "asin", "page", "pos", "review_id")


def _in_page(spark, sf_dir) -> DataFrame:
    return dedup.dedup_page(derive.paged(spark, sf_dir), ["asin"])


@query
def dedup_page_content(spark, sf_dir):
    return _in_page(spark, sf_dir).select("asin", "page", "pos", "review_id", "review_title")


@query
def dedup_cross_page(spark, sf_dir):
    rows = _in_page(spark, sf_dir).select("asin", "page", "pos", *REVIEW)
    return dedup.dedup_cross_page(rows, ["asin"], ["page", "pos"])


@query
def dedup_cross_page_hot(spark, sf_dir):
    """A third of all rows in one run, which is worked down in rounds."""
    rows = derive.typed(spark, sf_dir).withColumn(
        "asin", F.when(c("l_orderkey") % 3 == 0, F.lit("B000000000")).otherwise(c("asin")))
    placed = derive.with_pages(rows).select("asin", "page", "pos", *REVIEW)
    return dedup.dedup_cross_page(placed, ["asin"], ["page", "pos"], group_rows=1000).select(
        "asin", "page", "pos", "review_id")


def _two_pass(spark, sf_dir) -> DataFrame:
    return dedup.dedup_two_pass(derive.typed(spark, sf_dir), ORD, ["asin"])


@query
def dedup_two_pass(spark, sf_dir):
    return _two_pass(spark, sf_dir).select(*KEY, *REVIEW)


@query
def dedup_metrics(spark, sf_dir):
    return dedup.dedup_metrics(
        derive.table(spark, sf_dir, "lineitem"), _two_pass(spark, sf_dir))


@query
def dedup_metrics_written(spark, sf_dir):
    """As `dedup_metrics`, counted by the job that writes the rows."""
    counts = sinks.write_unique(derive.typed(spark, sf_dir), scratch_path(spark, "unique"), "parquet", ORD, ["asin"])
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


@query
def insert_if_absent(spark, sf_dir):
    rows = derive.typed(spark, sf_dir)
    existing = rows.filter(c("l_linestatus") == "O")
    return dedup.insert_if_absent(rows, existing, ORD).select(*KEY, "review_id")


# Ingest and metrics.

@query
def ingest_reviews(spark, sf_dir):
    return ingest.ingest_pages(derive.captured_pages(spark, sf_dir)).reviews.select(
        "asin", "domain", "star_filter", "page", "pos", *REVIEW, "canonical_product_url")


QUERIES["ingest"] = QUERIES.pop("ingest_reviews")


@query
def page_runs(spark, sf_dir):
    return ingest.ingest_pages(derive.captured_pages(spark, sf_dir)).runs


@query
def ingest_runs(spark, sf_dir):
    """Two runs over the same products; the first captured its first pages twice."""
    captured = derive.captured_pages(spark, sf_dir, stored=True)
    again = captured.filter("page = 1").withColumn("finished_at", c("finished_at") + F.expr("INTERVAL 1 SECOND"))
    runs = captured.unionByName(again).withColumn("run_id", F.lit("2024-01")).unionByName(
        captured.filter("page <= 2").withColumn("run_id", F.lit("2024-02")))
    return ingest.ingest_pages(runs).runs


@query
def ingest_existing(spark, sf_dir):
    """Page runs against a table that already holds some of the reviews."""
    existing = derive.typed(spark, sf_dir).filter(c("l_linestatus") == "O")
    return ingest.ingest_pages(derive.captured_pages(spark, sf_dir), existing).runs.select(
        "asin", "domain", "star_filter", "page", "reviews_parsed", "saved")


@query
def ingest_recap(spark, sf_dir):
    runs = ingest.ingest_pages(derive.captured_pages(spark, sf_dir)).runs
    return metrics.recap(metrics.labelled(runs))


@query
def ephemeral_run(spark, sf_dir):
    """A run without a table: nothing is stored but the export of what it found."""
    done = ingest.ingest_pages(derive.captured_pages(spark, sf_dir))
    path = sinks.write_rows(done.reviews, scratch_path(spark, "export"), "ndjson")
    return spark.read.schema(done.reviews.schema).json(path).select("asin", "page", "pos", "review_id", "rating")


@query
def ingest_tranches(spark, sf_dir):
    """Two star tranches per product; of an id in both, the tranche written first keeps it."""
    captured = derive.captured_pages(spark, sf_dir, stored=True)
    other = captured.filter("page <= 2 AND star_filter IS DISTINCT FROM 'three_star'").withColumn(
        "star_filter", F.lit("three_star"))
    none = derive.typed(spark, sf_dir).filter("false")
    return ingest.ingest_pages(captured.unionByName(other), none).new.select(
        "asin", "star_filter", "page", "pos", "review_id")


@query
def recap(spark, sf_dir):
    return metrics.recap(metrics.labelled(derive.event_runs(spark, sf_dir)))


@query
def recap_sorted(spark, sf_dir):
    return metrics.recap_sorted(metrics.labelled(derive.event_runs(spark, sf_dir)))


@query
def run_stats(spark, sf_dir):
    return metrics.run_stats(derive.event_runs(spark, sf_dir))


@query
def run_errors(spark, sf_dir):
    return metrics.run_errors(derive.event_runs(spark, sf_dir))


@query
def batch_totals(spark, sf_dir):
    stats = metrics.run_stats(derive.event_runs(spark, sf_dir))
    return metrics.batch_totals(stats.withColumn("success", c("error_count") == 0))


@query
def merged_stats(spark, sf_dir):
    stats = metrics.run_stats(derive.event_runs(spark, sf_dir))
    ranked = stats.withColumn(
        "star_rank", markets.star_label_rank(markets.star_label(c("star_filter"))))
    return metrics.merged_stats(ranked, ["asin", "domain"], "star_rank")


@query
def merged_batch(spark, sf_dir):
    return metrics.merged_stats(metrics.run_stats(derive.event_runs(spark, sf_dir)), [])


@query
def product_mean_rating(spark, sf_dir):
    return metrics.product_means(derive.typed(spark, sf_dir))


@query
def completeness(spark, sf_dir):
    return metrics.completeness(derive.event_runs(spark, sf_dir), DEFAULT_MAX_PAGES)


@query
def failures(spark, sf_dir):
    return metrics.failures(derive.event_runs(spark, sf_dir))


@query
def failed_products(spark, sf_dir):
    """Runs whose first page could not be read: zero statistics and its message; the batch goes on."""
    lost = derive.event_runs(spark, sf_dir).groupBy(*metrics.RUN).agg(
        F.min_by("error", "page").alias("message")).filter("message IS NOT NULL")
    return lost.select(F.inline(F.array(metrics.failed_run(c("asin"), c("message")))))


@query
def page_details(spark, sf_dir):
    return metrics.page_details(derive.event_runs(spark, sf_dir).drop("event_id"))


@query
def union_missing_cols(spark, sf_dir):
    """Runs that lack different columns; what a run lacks is NULL."""
    rows = derive.typed(spark, sf_dir).select(*KEY, "review_id", "rating", "variant", "l_returnflag")
    lacking = {"A": "variant", "N": "rating", "R": "l_returnflag"}
    runs = [rows.filter(c("l_returnflag") == flag).drop("l_returnflag", name) for flag, name in lacking.items()]
    return maintenance.union_runs(*runs)


@query
def progress_running(spark, sf_dir):
    return metrics.running_progress(derive.event_runs(spark, sf_dir), DEFAULT_MAX_PAGES).select(
        *metrics.RUN, "page", "saved_so_far", "known_total", "percent")


@query
def batch_progress(spark, sf_dir):
    items = url_list(spark, sf_dir).select("line_no", "asin")
    return metrics.batch_progress(items, ["line_no"], F.floor(c("line_no") / 65536))


# Ordered reads.

@query
def reviews_for_product(spark, sf_dir):
    return views.reviews_for_product(_reviews_table(spark, sf_dir), "B000000007", 20).select(
        "asin", "review_id", "review_date", "rating")


@query
def all_reviews_recent(spark, sf_dir):
    return views.all_reviews(_reviews_table(spark, sf_dir)).select(
        "review_id", "asin", "review_title", c("created_at").cast("timestamp_ntz").alias("created_at"))


@query
def recent_hundred(spark, sf_dir):
    return views.all_reviews(_reviews_table(spark, sf_dir), 100).select(
        "review_id", "asin", "review_title")


@query
def sentiment_sorted(spark, sf_dir):
    view = views.quality_view(derive.typed(spark, sf_dir), ORD, ["asin"])
    return view.select(*KEY, *REVIEW, "sentiment",
                       ratings.sentiment_rank(c("sentiment")).alias("sentiment_rank"))


@query
def latest_ten(spark, sf_dir):
    return views.latest_per_product(_reviews_table(spark, sf_dir)).select(
        "asin", "review_id", "review_date", "rating", "rank")


@query
def latest_of_product(spark, sf_dir):
    """The columns to show that the table has: `rating` and `body` are missing here."""
    table = _reviews_table(spark, sf_dir).withColumnRenamed("review_title", "title").drop("rating")
    return views.latest(table, "B000000007")


@query
def preview_head(spark, sf_dir):
    return views.preview(_two_pass(spark, sf_dir), ORD).select(*KEY, "review_id", "review_title")


# Unions, migration, import and export.

@query
def union_tranches(spark, sf_dir):
    rows = derive.typed(spark, sf_dir).select(*KEY, "review_id", "rating", "l_returnflag")
    runs = [rows.filter(c("l_returnflag") == flag) for flag in ("A", "N", "R")]
    return maintenance.union_runs(*runs).drop("l_returnflag")


@query
def migrate_titles(spark, sf_dir):
    old = derive.raw_reviews(spark, sf_dir, body=False).select(
        *KEY, F.when(c("l_linenumber") != 6, c("title")).alias("review_title"),
        c("l_shipdate").cast("timestamp").alias("updated_at"))
    never = F.to_timestamp(F.lit("9999-01-01 00:00:00"))
    return maintenance.migrate_titles(old, now=never).select(
        *KEY, "review_title", (c("updated_at") == never).alias("touched"))


@query
def migrate_titles_limited(spark, sf_dir):
    """The oldest 500 rows are processed; all others come back as they are."""
    shown = F.concat(F.lit("5 out of 5 stars "), "review_title")
    old = _reviews_table(spark, sf_dir).withColumn(
        "review_title", F.when(c("id") % 2 == 0, shown).otherwise(c("review_title")))
    never = F.to_timestamp(F.lit("9999-01-01 00:00:00"))
    return maintenance.migrate_titles(old, 500, never).select(
        "review_id", "review_title", (c("updated_at") == never).alias("touched"))


@query
def upsert_reviews(spark, sf_dir):
    """Newer, older and new rows against the stored table."""
    stored = _reviews_table(spark, sf_dir)
    return maintenance.upsert(stored, _changed(stored)).select("review_id", "asin", "review_title")


def _changed(stored: DataFrame) -> DataFrame:
    later = c("updated_at") + F.expr("INTERVAL 1 DAY")
    earlier = c("updated_at") - F.expr("INTERVAL 1 DAY")
    return stored.filter(c("id") % 4 != 3).withColumns({
        "review_title": F.concat(c("review_title"), F.lit(" v2")),
        "review_id": F.when(c("id") % 4 == 2, F.concat("review_id", F.lit("N"))).otherwise(c("review_id")),
        "updated_at": F.when(c("id") % 4 == 1, earlier).otherwise(later)})


@query
def rating_distribution(spark, sf_dir):
    return metrics.rating_distribution(_reviews_table(spark, sf_dir))


@query
def review_timeline(spark, sf_dir):
    return metrics.review_timeline(_reviews_table(spark, sf_dir))


@query
def url_distinct(spark, sf_dir):
    return readers.distinct_urls(url_list(spark, sf_dir)).select("line_no", "asin", "domain")


@query
def migrate_metrics(spark, sf_dir):
    return maintenance.migration_metrics(derive.raw_reviews(spark, sf_dir, body=False).select(
        c("title").alias("review_title")))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _imported(spark, sf_dir, read) -> DataFrame:
    """Write reviews under other column names, import the files and deduplicate."""
    rows = derive.typed(spark, sf_dir)
    renamed = rows.select(
        *ORD, "asin", c("review_id").alias("id"), c("review_title").alias("title"),
        c("review_body").alias("content"), c("reviewer_name").alias("user"),
        c("review_date").alias("date"), c("rating").cast("string").alias("stars"), "variant")
    path = sinks.write_rows(renamed, scratch_path(spark, "import"), "csv")
    unique = dedup.dedup_two_pass(readers.canonical_columns(read(path, _ddl(renamed))), ORD)
    texts = ["review_title", "review_body", "reviewer_name", "rating", "variant"]
    return unique.select(*KEY, "review_id", "review_date",
                         *[F.coalesce(n, F.lit("")).alias(n) for n in texts])


@query
def import_alias_dedup(spark, sf_dir):
    return _imported(spark, sf_dir, lambda path, ddl: readers.read_review_csv(spark, path, ddl))


@query
def import_csv_split(spark, sf_dir):
    """As `import_alias_dedup`; a quoted file is read by as many tasks as it has splits."""
    return _imported(spark, sf_dir, lambda path, ddl: csv_blocks.import_csv(spark, path, ddl)[0])


def _exported(spark, sf_dir, fmt: str) -> DataFrame:
    table = _reviews_table(spark, sf_dir).drop("created_at", "updated_at").withColumn(
        "created_at", F.lit(0))
    path = sinks.export_reviews(table, scratch_path(spark, "export"), fmt)
    back = {"csv": lambda: readers.read_review_csv(spark, path, _ddl(table)),
            "ndjson": lambda: spark.read.schema(table.schema).json(path),
            "parquet": lambda: spark.read.parquet(path)}[fmt]()
    texts = {"review_title", "review_body", "reviewer_name", "variant"}
    return back.select("id", "asin", "domain", "canonical_product_url",
                       *[F.coalesce(n, F.lit("")).alias(n) if n in texts else c(n)
                         for n in REVIEW])


@query
def export_roundtrip_csv(spark, sf_dir):
    return _exported(spark, sf_dir, "csv")


@query
def export_roundtrip_parquet(spark, sf_dir):
    return _exported(spark, sf_dir, "parquet")


@query
def export_ndjson(spark, sf_dir):
    return _exported(spark, sf_dir, "ndjson")


@query
def export_product_limit(spark, sf_dir):
    """One product's newest reviews; columns in the order of the table."""
    table = _reviews_table(spark, sf_dir).select("review_id", "rating", "review_date", "asin", "created_at")
    path = sinks.export_reviews(table, scratch_path(spark, "export"), "parquet", "B000000007", 5)
    # Nothing is exported of a product that has no review in the table.
    back = table.filter("false") if path is None else spark.read.parquet(path)
    return back.select("asin", "review_id", "review_date", "rating",
                       F.lit(",".join(back.columns)).alias("columns"))


@query
def export_page_details(spark, sf_dir):
    details = metrics.page_details(derive.event_runs(spark, sf_dir).drop("event_id"))
    path = sinks.write_rows(details, scratch_path(spark, "details"), "csv")
    return readers.read_review_csv(spark, path, _ddl(details))


@query
def last_run_export(spark, sf_dir):
    """Keep the results of one run per year, export the newest and read it back."""
    path = scratch_path(spark, "runs")
    sinks.write_run(derive.typed(spark, sf_dir).withColumn("run_id", F.year("l_shipdate")), path)
    out = sinks.export_last_run(spark, path, scratch_path(spark, "export"), "parquet", ORD)
    return spark.read.parquet(out).select(*KEY, "review_id", "rating", "sentiment")


@query
def append_to_table(spark, sf_dir):
    """Create the table, then append two batches; the first writer of an id wins."""
    path = scratch_path(spark, "reviews")
    sinks.ensure_reviews_table(spark, path)
    rows = derive.typed(spark, sf_dir)
    for status in ("O", "F"):
        batch = markets.enrich_product(rows.filter(c("l_linestatus") == status))
        sinks.append_reviews(batch, path, ORD, F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    return readers.read_reviews(spark, path).select(
        "asin", "review_id", "review_title", "rating", "review_date",
        c("created_at").cast("string").alias("created_at"), c("updated_at").cast("string").alias("updated_at"))


def _written_table(spark, sf_dir, rows: DataFrame) -> str:
    path = scratch_path(spark, "reviews")
    sinks.ensure_reviews_table(spark, path)
    sinks.append_reviews(rows, path, ["review_id"])
    return path


@query
def upsert_table(spark, sf_dir):
    """As `upsert_reviews`, on the table itself, in the buckets that the new rows touch."""
    path = _written_table(spark, sf_dir, _reviews_table(spark, sf_dir))
    sinks.upsert_reviews(_changed(readers.read_reviews(spark, path)), path)
    return readers.read_reviews(spark, path).select("review_id", "asin", "review_title")


@query
def migrate_table(spark, sf_dir):
    """Remove star mentions from the stored titles, a few buckets per commit."""
    shown = F.concat(F.lit("5 out of 5 stars "), "review_title")
    old = _reviews_table(spark, sf_dir).withColumn(
        "review_title", F.when(c("id") % 2 == 0, shown).otherwise(c("review_title")))
    path = _written_table(spark, sf_dir, old)
    never = F.to_timestamp(F.lit("9999-01-01 00:00:00"))
    sinks.migrate_table(spark, path, never)
    return readers.read_reviews(spark, path).select(
        "review_id", "review_title", (c("updated_at") == never).alias("touched"))


@query
def product_quality(spark, sf_dir):
    """Deduplicated reviews, their sentiment and a recap per product."""
    rows = views.with_sentiment(_two_pass(spark, sf_dir))
    return rows.groupBy("asin").agg(
        F.count("*").alias("reviews"),
        (F.sum(F.coalesce("rating", F.lit(0.0))) / F.count("*")).alias("mean_rating"),
        F.count_if(c("sentiment") == "Positif").alias("positive"),
        F.count_if(c("sentiment") == "Neutre").alias("neutral"),
        F.count_if(c("sentiment") == "Négatif").alias("negative"),
        F.count_if("verified_purchase").alias("verified"),
        F.sum("helpful_votes").alias("votes"),
        F.max("review_date").alias("last_date"))


# Streams, fed in two arrivals: the first two pages of every run, then the rest.

def _arrivals(spark, sf_dir, run, parts=("page <= 2", "page > 2"), files_per_batch: int = 64) -> None:
    source = scratch_path(spark, "captured")
    captured = derive.captured_pages(spark, sf_dir, stored=True).withColumn("run_id", F.lit("2024-01"))
    for part in parts:
        captured.filter(part).write.mode("append").option("compression", "zstd").parquet(source)
        run(streams.read_page_stream(spark, source, files_per_batch)).awaitTermination()


@query
def stream_parse(spark, sf_dir):
    out, state = scratch_path(spark, "parsed"), scratch_path(spark, "state")
    _arrivals(spark, sf_dir, lambda s: streams.stream_parse(s, out, state))
    return spark.read.parquet(out).select("asin", "page", "pos", *REVIEW)


def _deduplicated(spark, sf_dir, **arrivals) -> DataFrame:
    kept, state = scratch_path(spark, "kept"), scratch_path(spark, "state")
    _arrivals(spark, sf_dir, lambda s: streams.stream_dedup(s, kept, state), **arrivals)
    return spark.read.parquet(kept).select("asin", "page", "pos", "review_id", "review_title")


@query
def stream_dedup(spark, sf_dir):
    return _deduplicated(spark, sf_dir)


@query
def stream_dedup_shuffled(spark, sf_dir):
    """Pages arrive in no order, a file at a time: each waits for those before it."""
    parts = [f"pmod(xxhash64(asin, page), 3) = {i}" for i in range(3)]
    return _deduplicated(spark, sf_dir, parts=parts, files_per_batch=3)


def _ingested(spark, sf_dir) -> tuple[str, str]:
    table, rejects, state = (scratch_path(spark, n) for n in ("table", "rejects", "state"))
    sinks.ensure_reviews_table(spark, table)
    now = F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    _arrivals(spark, sf_dir, lambda s: streams.stream_ingest(s, table, rejects, state, now))
    return table, rejects


@query
def stream_ingest(spark, sf_dir):
    """The page loop into the reviews table."""
    table, _ = _ingested(spark, sf_dir)
    return readers.read_reviews(spark, table).select(
        "asin", "review_id", "review_title", "rating", "review_date",
        c("created_at").cast("string").alias("created_at"), c("updated_at").cast("string").alias("updated_at"))


@query
def stream_quarantine(spark, sf_dir):
    """Pages that the stream rejected unread, and why."""
    _, rejects = _ingested(spark, sf_dir)
    return spark.read.parquet(f"{rejects}/quarantined").select("asin", "page", "status")


@query
def stream_metrics(spark, sf_dir):
    out, state = scratch_path(spark, "metrics"), scratch_path(spark, "state")
    _arrivals(spark, sf_dir, lambda s: streams.stream_metrics(s, out, state))
    return streams.stream_recap(spark, out)


@query
def stream_progress(spark, sf_dir):
    """Progress of every run as its pages are decided; the last pages arrive first."""
    out, state = scratch_path(spark, "progress"), scratch_path(spark, "state")
    _arrivals(spark, sf_dir, lambda s: streams.stream_progress(s, out, state, DEFAULT_MAX_PAGES),
              parts=("page > 3", "page = 2", "page IN (1, 3)"))
    return spark.read.parquet(out).select("asin", "page", "saved_so_far", "known_total", "percent")
