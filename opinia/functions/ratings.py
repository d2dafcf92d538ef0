"""Rating text to number, and rating to sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinia.constants import NEGATIVE, NEUTRAL, POSITIVE
from opinia.functions.text import NUMBER, SPACE, let


def normalize_rating(text: Column) -> Column:
    """Rating between 1 and 5, or NULL.

    Each form is tried on its leftmost match; a value out of range falls
    through to the next form.
    """

    def number(source: Column) -> Column:
        value = F.replace(source, F.lit(","), F.lit(".")).try_cast("double")
        return let(value, lambda v: F.when(v.between(1.0, 5.0), v))

    first_number = F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1)
    # A pattern runs only on texts that hold the signs of its matches.
    sur = F.contains(text, F.lit("sur"))
    decimal = F.contains(text, F.lit(".")) | F.contains(text, F.lit(","))
    return F.coalesce(
        number(F.when(sur & decimal, F.regexp_extract(
            text, rf"(?U)({NUMBER}+[.,]{NUMBER}+){SPACE}*sur{SPACE}*5", 1))),
        number(F.when(decimal, F.regexp_extract(text, r"([0-9]+[.,][0-9]+)", 1))),
        # A whole number "sur 5": the value is the first number of the text.
        F.when(sur & text.rlike(rf"(?U){NUMBER}{SPACE}*sur{SPACE}*5"), number(first_number)),
        F.when(text.rlike(r"^[1-5](?:[.,]0)?\n?\z"), number(first_number)),
    )


def sentiment(rating: Column) -> Column:
    value = rating.try_cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(NEUTRAL))
        .when(value >= 4, F.lit(POSITIVE))
        .when(value <= 2, F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL))
    )


def sentiment_rank(label: Column) -> Column:
    """Display order: positive, neutral, negative."""
    return (
        F.when(label == POSITIVE, F.lit(0))
        .when(label == NEUTRAL, F.lit(1))
        .when(label == NEGATIVE, F.lit(2))
    )
