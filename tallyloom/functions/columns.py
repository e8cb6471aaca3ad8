"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def only(values: Column) -> Column:
    """The one different non-null value of an array, or null."""
    return let(F.array_distinct(F.array_compact(values)), lambda a: F.when(F.size(a) == 1, F.element_at(a, 1)))


def half_up(numerator: Column, denominator: Column) -> Column:
    """Integer quotient of non-negative whole numbers, halves rounded up."""
    return F.floor((2 * numerator + denominator) / (2 * denominator)).cast("long")


def lines_of(text: Column) -> Column:
    """The lines of a text, at every boundary that Unicode calls one."""
    return F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]")
