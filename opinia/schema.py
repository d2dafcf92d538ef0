"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

REVIEWS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("asin", T.StringType()),
    T.StructField("review_id", T.StringType()),
    T.StructField("review_title", T.StringType()),
    T.StructField("review_body", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    # Kept as text: impossible dates such as 2024-02-31 are legal values.
    T.StructField("review_date", T.StringType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("helpful_votes", T.IntegerType()),
    T.StructField("reviewer_name", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("canonical_product_url", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# One captured page.  `url` and `html` are all the extractor needs; the other
# columns place the page in its run.
PAGES = T.StructType([
    T.StructField("asin", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("star_filter", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    # Tells the captures of one tranche apart and sorts by time; NULL is a run like any other.
    T.StructField("run_id", T.StringType()),
])

# The raw strings of one review block, NULL where the element is absent.
BLOCK = T.StructType([
    T.StructField("id_href", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("star_rating", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("verified", T.StringType()),
    T.StructField("avp_badge", T.StringType()),
    T.StructField("helpful", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("variant", T.StringType()),
])

# What one pass over a page's HTML yields, besides the page's own columns.
EXTRACTED = T.StructType([
    T.StructField("matched_selector", T.StringType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("matched_blocks", T.ArrayType(BLOCK)),
    T.StructField("header_text", T.StringType()),
    T.StructField("jsonld_text", T.StringType()),
    T.StructField("rating_count_text", T.StringType()),
    T.StructField("account_text", T.StringType()),
    T.StructField("next_disabled", T.BooleanType()),
    T.StructField("next_link", T.BooleanType()),
    T.StructField("next_href", T.StringType()),
    T.StructField("error", T.StringType()),
])

PAGE_RUNS = T.StructType([
    T.StructField("asin", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("star_filter", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("reviews_parsed", T.LongType()),
    T.StructField("saved", T.LongType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("next", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("total_reviews_header", T.LongType()),
    T.StructField("product_global_review_count", T.LongType()),
])
