"""Market lookups: language, locale, currency, time zone, star codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.constants import (
    ALL_STARS_LABEL, DEFAULT_CURRENCY, DEFAULT_DOMAIN, DEFAULT_LANGUAGE,
    DEFAULT_TIMEZONE, LANGUAGE_BY_SUFFIX, MARKETS, STAR_CODE_BY_OPTION,
    STAR_LABEL_BY_CODE, TIMEZONE_BY_SUFFIX,
)
from opinia.functions.urls import generate_product_url


def market_language(domain: Column) -> Column:
    return _by_suffix(F.lower(domain), LANGUAGE_BY_SUFFIX, DEFAULT_LANGUAGE)


def market_timezone(domain: Column) -> Column:
    return _by_suffix(domain, TIMEZONE_BY_SUFFIX, DEFAULT_TIMEZONE)


def market_locale_currency(domain: Column, language: Column | None = None) -> Column:
    """Struct(locale, currency); an explicit language wins over the market's."""
    bare = F.regexp_replace(domain, r"^www\.", "")
    asked = F.lit(None).cast("string") if language is None else F.nullif(language, F.lit(""))
    locale = _lookup({k: v[0] for k, v in MARKETS.items()}, bare)
    currency = _lookup({k: v[1] for k, v in MARKETS.items()}, bare)
    return F.struct(
        F.coalesce(asked, locale, F.lit(DEFAULT_LANGUAGE)).alias("locale"),
        F.coalesce(currency, F.lit(DEFAULT_CURRENCY)).alias("currency"),
    )


def target_domain(choice: Column, url_domain: Column, batch: Column) -> Column:
    """Explicit choice, else the URL's domain outside batches, else the default."""
    return F.coalesce(
        F.nullif(choice, F.lit("")), F.when(~batch, url_domain), F.lit(DEFAULT_DOMAIN))


def star_code(option: Column) -> Column:
    """Filter code of a star option; NULL means every rating."""
    return _lookup(STAR_CODE_BY_OPTION, option)


def star_label(code: Column) -> Column:
    return F.coalesce(_lookup(STAR_LABEL_BY_CODE, code), F.lit(ALL_STARS_LABEL))


def star_label_rank(label: Column) -> Column:
    """Display order of star labels: five to one, then all."""
    order = [*STAR_LABEL_BY_CODE.values(), ALL_STARS_LABEL]
    return _lookup({v: i for i, v in enumerate(order)}, label)


def enrich_product(df: DataFrame) -> DataFrame:
    """Add the product page address where the domain is known."""
    known = F.col("domain").isNotNull() & (F.col("domain") != "")
    return df.withColumn(
        "canonical_product_url",
        F.when(known & (F.col("asin") != ""),
               generate_product_url(F.col("asin"), F.col("domain"))),
    )


def _by_suffix(domain: Column, table: dict[str, str], default: str) -> Column:
    result = F.lit(default)
    for suffix, value in table.items():
        result = F.when(F.endswith(domain, F.lit(suffix)), F.lit(value)).otherwise(result)
    return result


def _lookup(table: dict, key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)
