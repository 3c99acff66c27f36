"""Predicates of the query surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCHED = ("trade_date", "transaction_type", "ticker", "currency", "transaction_id", "note")


def contains_text(needle: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Case-insensitive substring in any of the columns; a blank needle matches everything."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def equals_text(c: Column, value) -> Column:
    """Equality on the upper-cased text form; a null filter value asks for nulls."""
    if value is None:
        return c.isNull()
    return F.upper(F.coalesce(c.cast("string"), F.lit(""))) == str(value).upper()


def from_date(c: Column, value) -> Column:
    """Inclusive text comparison: a null date compares as the word null and so passes."""
    return F.lit(True) if value is None else F.coalesce(c.cast("string"), F.lit("null")) >= str(value)


def to_date(c: Column, value) -> Column:
    """Inclusive text comparison: a null date compares as the word null and so fails."""
    return F.lit(True) if value is None else F.coalesce(c.cast("string"), F.lit("null")) <= str(value)
