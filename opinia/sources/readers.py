"""Readers: captured pages, stored reviews, review files, product and URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.constants import IMPORT_ALIASES
from opinia.functions.text import strip
from opinia.functions.urls import parse_product_url, validate_asin
from opinia.operators.ranking import keep_first, ordinal
from opinia.schema import REVIEWS


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages stored as Parquet; at least `url` and `html`."""
    return spark.read.parquet(path)


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder of saved pages, one document per file."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("url"), F.col("value").alias("html")))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Stored reviews: the table of `sinks`, in buckets, or any Parquet folder of reviews."""
    return spark.read.schema(REVIEWS).parquet(path).select(*REVIEWS.fieldNames())


def read_review_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An exported review file; its unnamed index column, if any, is `_c0`.

    Everything is read as text unless a schema is given.
    """
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"'))
    return (reader.schema(schema) if schema else reader).csv(path)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename the first column found among each field's aliases; '' when none.

    Other columns stay under their own names.
    """
    chosen = {name: next((c for c in names if c in df.columns), None)
              for name, names in IMPORT_ALIASES.items()}
    used = set(chosen.values())
    others = [F.col(c) for c in df.columns if c not in used and c not in chosen]
    named = [(F.col(c) if c else F.lit("")).alias(n) for n, c in chosen.items()]
    return df.select(*others, *named)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with exact 1-based line numbers per file.

    Splits of a file are the ordered buckets, so no file passes one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("line"),
    )
    return ordinal(lines, ["file"], F.col("_split"), ["_seq"], "line_no").drop("_split", "_seq")


def meaningful(line: Column) -> Column:
    """Neither blank nor a comment."""
    bare = strip(line)
    return (bare != "") & ~F.startswith(bare, F.lit("#"))


def product_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid product codes and rejected lines; repeated codes stay repeated."""
    codes = (lines.filter(meaningful(F.col("line")))
             .withColumn("asin", strip(F.col("line"))).drop("line"))
    valid = validate_asin(F.col("asin"))
    return codes.filter(valid), codes.filter(~valid)


def read_product_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As `product_list` on a file; a file without a valid code is an error."""
    valid, bad = product_list(numbered_lines(spark, path))
    if valid.isEmpty():
        raise ValueError(f"no valid product code in {path}")
    return valid, bad


def url_list(lines: DataFrame) -> DataFrame:
    """Parsed product URLs of a list; lines without a product code are dropped."""
    kept = [c for c in lines.columns if c != "line"]
    stripped = lines.filter(meaningful(F.col("line"))).select(
        *kept, strip(F.col("line")).alias("url"))
    # `inline` parses a line once; a filter on a projected struct would parse twice.
    parsed = stripped.select(*kept, "url", F.inline(F.array(parse_product_url(F.col("url")))))
    return parsed.filter(F.col("asin") != "")


def distinct_urls(urls: DataFrame, order: str = "line_no") -> DataFrame:
    """The first line of every product address of a `url_list` (code and market)."""
    return keep_first(urls, ["asin", "domain"], [order])


def url_counts(lines: DataFrame) -> DataFrame:
    """One row: lines that are neither blank nor comments, and those with a product code."""
    listed = lines.filter(meaningful(F.col("line")))
    code = parse_product_url(strip(F.col("line")))["asin"]
    return listed.agg(F.count("*").alias("listed"),
                      F.count_if(F.coalesce(code, F.lit("")) != "").alias("parsable"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_list(numbered_lines(spark, path))
