"""Small string expressions shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and the regex class \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)

# The same set as a Java regex class, usable with or without the (?U) flag.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# ... without the line feed, for patterns that must stay on one line.
WS_INLINE = (
    r"[\t\x{0b}\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def column(value: Column | str) -> Column:
    """A column given by name or as an expression."""
    return value if isinstance(value, Column) else F.col(value)


def strip(value: Column | str) -> Column:
    """Remove white space at both ends; one linear pass, no regex."""
    return F.trim(column(value), F.lit(WHITESPACE))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(column(value), F.lit(""))


def first_group(value: Column | str, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL instead of an empty string when nothing matches."""
    return blank_to_null(F.regexp_extract(column(value), pattern, group))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
