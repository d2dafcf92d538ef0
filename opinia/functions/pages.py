"""Page predicates and page-level numbers (Column -> Column).

A page is lowered once per test (`let`): filters do not share subexpressions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.constants import (
    CHALLENGE_MARKERS, ERROR_MARKERS, LOGIN_MARKERS, SIGN_IN_INVITATIONS,
)
from opinia.functions.text import let, localized_int

USABLE_STATUS = ("ok", "error")
# Markers of the classes of pages, in the order in which they are tried; a page without any is 'ok'.
STATUS_MARKERS = {"challenge": CHALLENGE_MARKERS, "login": LOGIN_MARKERS, "error": ERROR_MARKERS}


def is_challenge(html: Column) -> Column:
    return let(F.lower(html), lambda low: _mentions(low, CHALLENGE_MARKERS))


def is_error(html: Column) -> Column:
    return let(F.lower(html), lambda low: _mentions(low, ERROR_MARKERS))


def is_login(html: Column) -> Column:
    return let(F.lower(html), lambda low: _mentions(low, LOGIN_MARKERS))


def page_status(html: Column) -> Column:
    """'challenge', 'login', 'error' or 'ok'; only the first two are rejected."""
    return let(F.lower(html), lambda low: (
        F.when(_mentions(low, CHALLENGE_MARKERS), F.lit("challenge"))
        .when(_mentions(low, LOGIN_MARKERS), F.lit("login"))
        .when(_mentions(low, ERROR_MARKERS), F.lit("error"))
        .otherwise(F.lit("ok"))
    ))


def is_signed_out(html: Column, account_text: Column) -> Column:
    """A login page, or an account link that invites to sign in.

    A page without an account link counts as signed in.
    """
    return is_login(html) | _mentions(account_text, SIGN_IN_INVITATIONS)


def header_total(text: Column) -> Column:
    """Number of reviews announced above the list."""
    return localized_int(text, nbsp=True)


def product_review_count(jsonld: Column, visible: Column) -> Column:
    """Product-wide count: from the page's JSON-LD, else from its visible text."""
    stated = F.regexp_extract(jsonld, r'"reviewCount"\s*:\s*([0-9,.]+)', 1)
    return F.coalesce(
        F.translate(stated, ",.", "").try_cast("bigint"),
        localized_int(visible, nbsp=False),
    )


def triage(pages: DataFrame) -> DataFrame:
    """Add `page_status`; rejects are the rows whose status is not usable."""
    return pages.withColumn("page_status", page_status(F.col("html")))


def usable(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("page_status").isin(*USABLE_STATUS))


def rejected(triaged: DataFrame) -> DataFrame:
    return triaged.filter(~F.col("page_status").isin(*USABLE_STATUS))


def status_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("page_status").agg(F.count("*").alias("pages"))


def _mentions(text: Column, markers: tuple[str, ...]) -> Column:
    found = reduce(or_, [F.contains(text, F.lit(m)) for m in markers])
    return F.coalesce(found, F.lit(False))
