"""Text, vote, badge and key normalisers (Column -> Column).

Patterns carry `(?U)` so that white space is Unicode white space, to which
`SPACE` adds U+001C-U+001F.  Digits are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
NUMBER = "[0-9]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def clean_text(text: Column) -> Column:
    """Control characters and white space become single spaces; NULL becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)[\s\p{Cc}]+", " ")), F.lit(""))


def normalize_helpful_votes(text: Column) -> Column:
    """First count found by the most specific phrase; 0 when there is none."""
    phrases = (
        ("utile", rf"(?U)({NUMBER}+){SPACE}+personnes?{SPACE}+ont{SPACE}+trouvé{SPACE}+cela{SPACE}+utile"),
        ("found", rf"(?U)({NUMBER}+){SPACE}+people?{SPACE}+found{SPACE}+this{SPACE}+helpful"),
        ("utile", rf"(?U)({NUMBER}+){SPACE}+utile"),
        ("", rf"({NUMBER}+)"),
    )

    def count(low: Column) -> Column:
        # A phrase is looked for only in texts that hold its word.
        found = [F.when(F.contains(low, F.lit(word)), F.regexp_extract(low, p, 1)) for word, p in phrases]
        return F.coalesce(*[F.nullif(f, F.lit("")) for f in found]).try_cast("int")

    return F.coalesce(let(F.lower(text), count), F.lit(0))


def normalize_verified_purchase(text: Column) -> Column:
    low = F.lower(text)
    denied = F.contains(low, F.lit("pas vérifié")) | F.contains(low, F.lit("not verified"))
    stated = F.contains(low, F.lit("vérifié")) | F.contains(low, F.lit("verified"))
    return F.coalesce(~denied & stated, F.lit(False))


def strip_rating_from_title(text: Column) -> Column:
    """Drop a leading star mention (French, then English) and star symbols."""
    lead = rf"(?iuU)^{SPACE}*{NUMBER}+[.,]?{NUMBER}*{SPACE}*"
    tail = rf"{SPACE}*[-–—]*{SPACE}*"
    bare = F.regexp_replace(text, rf"{lead}sur{SPACE}*5{SPACE}*étoiles?{tail}", "")
    bare = F.regexp_replace(
        bare, rf"{lead}out{SPACE}*of{SPACE}*5{SPACE}*stars?{tail}", "")
    # The symbols may stand among white space, so strip both together.
    return clean_text(F.regexp_replace(bare, r"(?U)^[★☆\s\x1c-\x1f]+", ""))


def canonical_review_id(title: Column, body: Column) -> Column:
    """Stable id of a review that carries none: hash of its cleaned text."""
    return clean_review_id(clean_text(title), clean_text(body))


def clean_review_id(title: Column, body: Column) -> Column:
    """`canonical_review_id` of texts that are clean already."""
    return F.concat(F.lit("sha1_"), _text_hash(title, body))


def content_key(title: Column, body: Column, author: Column, date: Column,
                rating: Column, variant: Column) -> Column:
    """Hash of the cleaned text or, for a review without text, of its facts."""
    facts = _text_hash(
        clean_text(author),
        F.coalesce(date, F.lit("")),
        # A zero rating counts as none.
        F.coalesce(F.when(F.coalesce(rating.try_cast("double"), F.lit(1.0)) != 0,
                          rating.cast("string")), F.lit("")),
        clean_text(variant),
    )
    texts = F.struct(clean_text(title).alias("t"), clean_text(body).alias("b"))
    return let(texts, lambda x: F.when(
        (x["t"] != "") | (x["b"] != ""), _text_hash(x["t"], x["b"])).otherwise(facts))


def content_pair(title: Column, body: Column) -> Column:
    """Fixed-size stand-in for the pair (clean title, clean body).

    Cleaned text holds no control character, so U+001F keeps pairs apart.
    """
    return clean_pair(clean_text(title), clean_text(body))


def clean_pair(title: Column, body: Column) -> Column:
    """`content_pair` of texts that are clean already."""
    return F.sha2(F.concat_ws("\x1f", title, body), 256)


def localized_int(text: Column, nbsp: bool = True) -> Column:
    """First grouped number of a text ('1 234', '1.234', '1,234') as an integer.

    `nbsp` says whether no-break spaces group digits as well; without it a
    number grouped by them is NULL.
    """
    source = F.translate(text, "\N{NO-BREAK SPACE}\N{NARROW NO-BREAK SPACE}", "  ") if nbsp else text
    number = F.regexp_extract(source, r"(?U)([0-9][0-9.,\s\x1c-\x1f]*)", 1)
    return strip(F.translate(number, " .,", "")).try_cast("bigint")


def _text_hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))
