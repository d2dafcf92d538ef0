"""Raw blocks to typed review records, and the checks on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.constants import COLUMN_LIMITS
from opinia.functions.dates import normalize_date
from opinia.functions.ratings import normalize_rating
from opinia.functions.text import (
    canonical_review_id, clean_text, normalize_helpful_votes,
    normalize_verified_purchase, strip_rating_from_title,
)
from opinia.functions.urls import review_id_from_url
from opinia.schema import BLOCK, REVIEWS


def resolve_review_id(href: Column, title: Column, body: Column, strict: bool = False) -> Column:
    """Id in the block's link, else a hash of its raw text.

    Strictly, a link decides alone, and a block without text has no id.
    """
    linked = review_id_from_url(href)
    hashed = canonical_review_id(title, body)
    if not strict:
        return F.coalesce(linked, hashed)
    has_text = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(body, F.lit("")) != "")
    return F.when(F.coalesce(href, F.lit("")) != "", linked).when(has_text, hashed)


def typed_fields(block: dict[str, Column], strict: bool = False) -> dict[str, Column]:
    """Typed columns of one raw block."""

    def text(name: str, build) -> Column:
        value = build(block[name])
        return F.when(block[name].isNotNull(), value) if strict else value

    return {
        "review_title": text("title", strip_rating_from_title),
        "review_body": text("body", clean_text),
        "rating": normalize_rating(block["star_rating" if strict else "rating"]),
        "review_date": normalize_date(block["date"]),
        "verified_purchase":
            normalize_verified_purchase(block["avp_badge" if strict else "verified"]),
        "helpful_votes": normalize_helpful_votes(block["helpful"]),
        "reviewer_name": text("reviewer", clean_text),
        "variant": text("variant", clean_text),
    }


def typed_reviews(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Typed records of exploded blocks; other columns stay.

    Strict mode leaves absent elements NULL, and drops records without id or
    failing `is_valid_review`.
    """
    raw = {name: F.col(name) for name in BLOCK.fieldNames()}
    kept = [c for c in blocks.columns if c not in raw]
    records = blocks.select(
        *kept,
        resolve_review_id(raw["id_href"], raw["title"], raw["body"], strict).alias("review_id"),
        *[c.alias(n) for n, c in typed_fields(raw, strict).items()],
    )
    if strict:
        records = records.filter(F.col("review_id").isNotNull() & is_valid_review())
    return records


def is_valid_review() -> Column:
    """Some text, and a rating that is absent or between 1 and 5."""
    has_text = (F.coalesce("review_title", F.lit("")) != "") | (
        F.coalesce("review_body", F.lit("")) != "")
    return has_text & F.coalesce(F.col("rating").between(1.0, 5.0), F.lit(True))


def storage_problem() -> Column:
    """Why a record cannot be stored, or NULL: first missing key or long text."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in ("asin", "review_id")]
    checks += [
        F.when(F.char_length(c) > limit, F.lit(f"{c} too long"))
        for c, limit in COLUMN_LIMITS.items()
    ]
    return F.coalesce(*checks)


def storable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that fit the table, and the others with their `problem`."""
    checked = df.withColumn("problem", storage_problem())
    return (checked.filter(F.col("problem").isNull()).drop("problem"),
            checked.filter(F.col("problem").isNotNull()))


def coerce_defaults(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Absent badge is false, absent or non-numeric votes are 0, absent times `now`."""
    now = F.current_timestamp() if now is None else now
    return df.withColumns({
        "verified_purchase": F.coalesce(F.col("verified_purchase").cast("boolean"), F.lit(False)),
        "helpful_votes": F.coalesce(F.col("helpful_votes").try_cast("int"), F.lit(0)),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.coalesce("updated_at", now),
    })


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text; microseconds only where there are any."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(
        F.concat(seconds, F.lit("."), micros))


def project_record(df: DataFrame) -> DataFrame:
    """The fifteen record fields in order, times as ISO text."""
    return df.select(*[
        iso_timestamp(F.col(c)).alias(c) if c in ("created_at", "updated_at") else F.col(c)
        for c in REVIEWS.fieldNames()
    ])


def conform(df: DataFrame) -> DataFrame:
    """The stored columns in order and type; NULL where a record lacks one."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in REVIEWS.fields
    ])
