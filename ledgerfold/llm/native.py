"""Column helpers shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = "[\\x20\\x09-\\x0D]+"
#: White space that ``btrim`` takes off before a split.
WHITE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other letters stay."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def white_words(text: Column) -> Column:
    """The words between ASCII white space; null and blank texts have none."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE)))

