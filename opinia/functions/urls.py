"""Product codes and review/product URLs (Column -> Column).

A URL is split by one RFC 3986 pattern rather than `parse_url`, which gives up
on raw spaces; a URL without scheme then has no authority and is all path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinia.constants import (
    DEFAULT_DOMAIN, DEFAULT_REVIEWER_TYPE, DEFAULT_SORT, DEFAULT_STAR_FILTER,
)
from opinia.functions.text import let

_SPLIT = r"(?s)^([^:/?#]+:)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?(#.*)?"
_REVIEWS_CODE = r"(?:^|/)product-reviews/([^/]*)"
_PRODUCT_CODE = r"(?:^|/)(?:dp|gp/+product)/+([^/]+)"


def validate_asin(code: Column) -> Column:
    """Exactly ten letters or digits, of any script."""
    return F.coalesce(code.rlike(r"^[\p{L}\p{N}]{10}\z"), F.lit(False))


def generate_review_url(asin: Column, page: Column | None = None, *,
                        language: Column | None = None, sort: Column | None = None,
                        domain: Column | None = None,
                        reviewer_type: Column | None = None,
                        star_filter: Column | None = None) -> Column:
    """Review list URL of a product; values are written as they are."""
    page = F.lit(1) if page is None else page
    return F.concat(
        F.lit("https://"), _given(domain, DEFAULT_DOMAIN),
        F.lit("/product-reviews/"), asin,
        F.lit("/?reviewerType="),
        F.lit(DEFAULT_REVIEWER_TYPE) if reviewer_type is None else reviewer_type,
        F.lit("&sortBy="), _given(sort, DEFAULT_SORT),
        F.lit("&filterByStar="), _given(star_filter, DEFAULT_STAR_FILTER),
        F.lit("") if language is None else F.when(
            _filled(language), F.concat(F.lit("&filterByLanguage="), language),
        ).otherwise(""),
        F.when(page > 1, F.concat(F.lit("&pageNumber="), page.cast("string"))).otherwise(""),
    )


def generate_product_url(asin: Column, domain: Column | None = None) -> Column:
    return F.concat(F.lit("https://"), _given(domain, DEFAULT_DOMAIN), F.lit("/dp/"), asin)


def parse_reviews_url(url: Column) -> Column:
    """Struct(asin, domain, language, sort, reviewer_type) of a review list URL."""
    return let(_split(url), lambda parts: F.when(_parsable(parts), _reviews_page(parts)))


def parse_product_url(url: Column) -> Column:
    """As `parse_reviews_url`, falling back to /dp/ and /gp/product/ pages."""

    def parsed(parts: Column) -> Column:
        code = F.regexp_extract(parts["path"], _PRODUCT_CODE, 1)
        product = _fields(
            code, parts, F.lit(None).cast("string"), F.lit(DEFAULT_REVIEWER_TYPE))
        return F.when(_parsable(parts), F.when(
            F.regexp_extract(parts["path"], _REVIEWS_CODE, 1) != "", _reviews_page(parts),
        ).when(code != "", product))

    return let(_split(url), parsed)


def review_id_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/reviews/([A-Z0-9]+)", 1), F.lit(""))


def next_page_url(url: Column, href: Column | None = None) -> Column:
    """The next link when the page has one, else the URL with pageNumber + 1.

    Rebuilding keeps the first non-blank value of every parameter, in order of
    appearance, and adds pageNumber at the end when it was missing.
    """
    def rebuilt(parts: Column) -> Column:
        pairs = F.filter(F.split(parts["query"], "&"), lambda pair: pair.rlike("(?s)^[^=]*=."))
        return let(F.transform(pairs, lambda pair: F.struct(
            _decode(F.substring_index(pair, "=", 1)).alias("k"),
            _decode(F.regexp_replace(pair, "^[^=]*=", "")).alias("v"),
        )), lambda decoded: _with_next_page(parts, decoded))

    built = let(_split(url), rebuilt)
    return built if href is None else F.coalesce(F.nullif(href, F.lit("")), built)


def _with_next_page(parts: Column, decoded: Column) -> Column:
    names = F.transform(decoded, lambda p: p["k"])
    firsts = F.filter(decoded, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    page = F.coalesce(
        F.get(F.filter(firsts, lambda p: p["k"] == "pageNumber"), F.lit(0))["v"], F.lit("1"))
    following = (page.try_cast("bigint") + 1).cast("string")
    written = F.transform(firsts, lambda p: F.concat(
        _encode(p["k"]), F.lit("="),
        F.when(p["k"] == "pageNumber", following).otherwise(_encode(p["v"])),
    ))
    query = F.array_join(
        F.when(F.array_contains(names, "pageNumber"), written)
        .otherwise(F.concat(written, F.array(F.concat(F.lit("pageNumber="), following)))),
        "&",
    )
    return F.when(_parsable(parts) & following.isNotNull(), F.concat(
        F.lower(parts["scheme"]), parts["slashes"], parts["authority"], parts["full_path"],
        F.lit("?"), query, parts["fragment"]))


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def _given(value: Column | None, default: str) -> Column:
    """The value, or the default where it is NULL or empty."""
    if value is None:
        return F.lit(default)
    return F.when(_filled(value), value).otherwise(F.lit(default))


def _split(url: Column) -> Column:
    """The parts of a URL; the query without its question mark."""
    def part(group: int) -> Column:
        return F.regexp_extract(url, _SPLIT, group)

    return F.struct(
        _filled(url).alias("given"),
        part(1).alias("scheme"),
        part(2).alias("slashes"),
        part(3).alias("authority"),
        part(4).alias("full_path"),
        # ";parameters" of the last segment are not part of the path.
        F.regexp_replace(part(4), r";[^/]*\z", "").alias("path"),
        part(5).alias("query"),
        part(6).alias("fragment"),
    )


def _parsable(parts: Column) -> Column:
    return parts["given"] & (F.contains(parts["authority"], F.lit("["))
                             == F.contains(parts["authority"], F.lit("]")))


def _reviews_page(parts: Column) -> Column:
    path = parts["path"]
    code = F.when(path.rlike(_REVIEWS_CODE), F.regexp_extract(path, _REVIEWS_CODE, 1))
    kind = F.coalesce(_parameter(parts["query"], "reviewerType"), F.lit(DEFAULT_REVIEWER_TYPE))
    return _fields(code, parts, _parameter(parts["query"], "sortBy"), kind)


def _fields(code: Column, parts: Column, sort: Column, reviewer_type: Column) -> Column:
    return F.struct(
        code.alias("asin"),
        _given(parts["authority"], DEFAULT_DOMAIN).alias("domain"),
        F.coalesce(_parameter(parts["query"], "language"),
                   _parameter(parts["query"], "languageLocale")).alias("language"),
        sort.alias("sort"),
        reviewer_type.alias("reviewer_type"),
    )


def _parameter(query: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded."""
    raw = F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return _decode(raw)


def _decode(value: Column) -> Column:
    # A stray percent sign stands for itself.
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(value: Column) -> Column:
    encoded = F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))
