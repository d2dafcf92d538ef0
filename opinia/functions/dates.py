"""Multilingual date text to 'YYYY-MM-DD' strings.

Each written form is tried on its leftmost match.  Day and month ranges are
checked, the calendar is not: 31 February stays what the page said.  The forms
share bound sub-values through `let`, which also keeps generated code small, and a
pattern runs only on text that holds the sign every match of it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinia.constants import (
    MONTHS_DE, MONTHS_EN, MONTHS_ES, MONTHS_FR, MONTHS_IT, MONTHS_NL,
)
from opinia.functions.text import SPACE, WORD, let

_DAY = "([0-9]{1,2})"
_YEAR = "([0-9]{4})"
# Possessive: a word and the space after it share no character.
_NAME = rf"({WORD}++)"
_DAY_FR = rf"(?U)([0-9]{{1,2}}|1er){SPACE}+{_NAME}{SPACE}+{_YEAR}"
_LE_DAY_FR = rf"(?U)le{SPACE}+([0-9]{{1,2}}|1er){SPACE}+{_NAME}{SPACE}+{_YEAR}"
_SLASHED = rf"{_DAY}/{_DAY}/{_YEAR}"
_ISO = rf"{_YEAR}-{_DAY}-{_DAY}"
_DAY_MONTH = rf"(?U){_DAY}{SPACE}+{_NAME}{SPACE}+{_YEAR}"
_MONTH_DAY = rf"(?U){_NAME}{SPACE}+{_DAY},{SPACE}*{_YEAR}"
_DAY_DE_MONTH = rf"(?U){_DAY}{SPACE}+de{SPACE}+{_NAME}{SPACE}+de{SPACE}+{_YEAR}"
_DAY_DOT_MONTH = rf"(?U){_DAY}[.|\s\x1c-\x1f]+{_NAME}{SPACE}+{_YEAR}"
_NUMERIC = rf"{_DAY}[./-]{_DAY}[./-]{_YEAR}"


def normalize_date_fr(text: Column) -> Column:
    """French forms and the two numeric forms tried with them."""
    return let(F.lower(text), lambda low: let(_groups(low, _DAY_MONTH), lambda plain: _french(low, plain)))


def normalize_date(text: Column) -> Column:
    """French, English, Spanish, Italian, German, Dutch, then numeric forms."""

    def forms(low: Column) -> Column:
        return let(
            # "15 march 2024" serves four languages, tried at different turns.
            _groups(low, _DAY_MONTH),
            lambda plain: F.coalesce(
                _french(low, plain),
                _read(_groups(low, _MONTH_DAY, ","), lambda g: _named(g[1], g[0], g[2], MONTHS_EN)),
                _words(plain, MONTHS_EN),
                _read(_groups(low, _DAY_DE_MONTH, "de"), lambda g: _named(*_three(g), MONTHS_ES)),
                _words(plain, MONTHS_IT),
                _read(_groups(low, _DAY_DOT_MONTH), lambda g: _named(*_three(g), MONTHS_DE)),
                _words(plain, MONTHS_NL),
                _read(_groups(low, _NUMERIC), lambda g: _numbered(*_three(g))),
            ),
        )

    return let(F.lower(text), forms)


def _french(low: Column, plain: Column) -> Column:
    """`plain` is the leftmost `_DAY_MONTH`, which is that of `_DAY_FR` in a text without "1er"."""

    def worded(g: Column) -> Column:
        return _named(F.when(g[0] == "1er", F.lit("1")).otherwise(g[0]), g[1], g[2], MONTHS_FR, year_as_written=True)

    either = F.when(F.contains(low, F.lit("1er")), _groups(low, _DAY_FR)).otherwise(plain)
    return F.coalesce(
        _read(_groups(low, _LE_DAY_FR, "le"), worded),
        _read(either, worded),
        _read(_groups(low, _SLASHED, "/"), lambda g: _numbered(*_three(g))),
        _read(_groups(low, _ISO, "-"), lambda g: _numbered(g[2], g[1], g[0])),
    )


def _groups(text: Column, pattern: str, sign: str = "") -> Column:
    """The three groups of the leftmost match, read from the match alone; NULL without one or without `sign`."""
    found = F.regexp_extract(text, pattern, 0)
    return let(F.when(F.contains(text, F.lit(sign)), found) if sign else found, lambda hit: F.when(
        hit != "", F.array(*[F.regexp_extract(hit, pattern, i) for i in (1, 2, 3)])))


def _read(groups: Column, build: Callable[[Column], Column]) -> Column:
    """Groups are found once, however often `build` asks for them."""
    return let(groups, lambda g: F.when(g.isNotNull(), build(g)))


def _three(groups: Column) -> list[Column]:
    return [groups[i] for i in range(3)]


def _words(plain: Column, months: dict[str, str]) -> Column:
    return F.when(plain.isNotNull(), _named(*_three(plain), months))


def _named(day: Column, month: Column, year: Column, months: dict[str, str],
           year_as_written: bool = False) -> Column:
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    shown_year = year if year_as_written else year.try_cast("int").cast("string")
    # NULL for an unknown month makes the whole date NULL.
    return let(day.try_cast("int"), lambda number: F.when(
        number.between(1, 31),
        F.concat(shown_year, F.lit("-"), F.try_element_at(table, month),
                 F.lit("-"), F.lpad(number.cast("string"), 2, "0")),
    ))


def _numbered(day: Column, month: Column, year: Column) -> Column:
    d, m = day.try_cast("int"), month.try_cast("int")
    return F.when(
        d.between(1, 31) & m.between(1, 12),
        F.concat(year.try_cast("int").cast("string"), F.lit("-"),
                 F.lpad(m.cast("string"), 2, "0"), F.lit("-"),
                 F.lpad(d.cast("string"), 2, "0")),
    )
