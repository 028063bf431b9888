"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space, no-break space included, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s\\p{Z}\\x1C-\\x1F&&[^\\u2007\\u202F]]+", " "))


def collapse_whitespace(text: Column, strip_leading: bool = False) -> Column:
    """Runs of the five HTML white space characters become one space."""
    out = F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " ")
    return F.ltrim(out) if strip_leading else out


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike("[^ \\t\\n\\f\\r]"), F.lit(True))


def is_numeric(text: Column) -> Column:
    return F.coalesce(text.rlike("^\\p{Nd}+$"), F.lit(False))


def is_whitespace(char: Column) -> Column:
    return char.rlike("^[ \\t\\n\\f\\r]$")


def padding(n: Column) -> Column:
    return F.when(n < 0, F.raise_error(F.lit("width must not be negative"))).otherwise(F.repeat(F.lit(" "), n))


def join(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def is_in(needle: Column, hay: Column) -> Column:
    return F.array_contains(hay, needle)
