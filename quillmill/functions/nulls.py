"""One meaning of "missing": null, empty or blank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that providers write for a missing text.
PLACEHOLDERS = ("na", "n/a", "none", "null")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nz(value: Column | str) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(as_column(value).cast("string")), F.lit(""))


def has_value(value: Column | str) -> Column:
    return nz(value).isNotNull()


def first_value(*values: Column | str) -> Column:
    """The first value that isn't missing, or an empty text."""
    return F.coalesce(*(nz(v) for v in values), F.lit(""))


def fill(current: Column | str, incoming: Column | str) -> Column:
    """``current`` unless it is missing."""
    return F.when(has_value(current), as_column(current)).otherwise(as_column(incoming))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
