"""Arrays and values that count as missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def no_strings() -> Column:
    return F.array().cast(EMPTY)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def or_empty(a: Column, kind: str = EMPTY) -> Column:
    return F.coalesce(a, F.array().cast(kind))


def text_or(a: Column, b: Column) -> Column:
    """The first unless it is null or empty."""
    return F.when(a != "", a).otherwise(b)


def number_or(a: Column, b: Column) -> Column:
    """The first unless it is null or 0."""
    return F.when(a != 0, a).otherwise(b)


def list_or(a: Column, b: Column) -> Column:
    """The first unless it is null or has no element."""
    return F.when(F.size(a) > 0, a).otherwise(b)


def clean_list(a: Column) -> Column:
    """Trimmed, without empty strings."""
    return F.filter(F.transform(or_empty(a), lambda x: F.trim(x)), lambda x: x != "")


def string_list(c: Column) -> Column:
    """A string's parts between commas or semicolons, trimmed, without empty ones."""
    return F.when(c.isNotNull(), clean_list(F.split(F.replace(c, F.lit(";"), F.lit(",")), ","))).otherwise(no_strings())


def distinct_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """Elements whose key no earlier element has."""
    keys = F.transform(a, key)
    return F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def distinct_ignoring_case(a: Column) -> Column:
    return distinct_by(clean_list(a), F.lower)


def ordered_union(lists: Column) -> Column:
    """Distinct elements of lists in order of first appearance."""
    return F.array_distinct(F.flatten(lists))


def split_by_first(c: Column, separators: tuple[str, ...]) -> Column:
    """Parts between the first of the separators that the string has; else the string alone."""
    out = F.array(c)
    for s in reversed(separators):
        out = F.when(F.contains(c, F.lit(s)), F.split(c, "\\" + s)).otherwise(out)
    return F.when(c.isNotNull(), clean_list(out)).otherwise(no_strings())
