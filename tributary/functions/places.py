"""Locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.arrays import text_or
from tributary.functions.dims import COUNTRIES, REMOTE, STATES, lookup
from tributary.functions.text import null_if_empty

PLACE = "struct<city: string, state: string, country: string, country_code: string, postal_code: string, raw: string>"
PARTS = ("city", "state", "country", "country_code", "postal_code")
STATE_NAMES = {name.lower(): code.upper() for code, name in STATES.items()}


def place(city=None, state=None, country=None, country_code=None, postal_code=None, raw=None) -> Column:
    """A location of the parts given."""
    given = {"city": city, "state": state, "country": country, "country_code": country_code, "postal_code": postal_code, "raw": raw}
    return F.struct(*((F.lit(None) if v is None else v).cast("string").alias(k) for k, v in given.items()))


def parse_place(c: Column) -> Column:
    """``City``, ``City, State``, ``City, Country`` or ``City, State, Country``; an abbreviated state is written out in the second form only."""
    s = F.trim(c)
    parts = F.transform(F.split(s, ","), lambda x: F.trim(x))
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    code = lookup(COUNTRIES, F.lower(second))
    in_us = lookup(STATES, F.lower(second)).isNotNull() | lookup(STATE_NAMES, F.lower(second)).isNotNull()
    size, nothing = F.size(parts), F.lit(None).cast("string")
    return F.when(
        null_if_empty(s).isNotNull(),
        F.when(F.lower(s).isin(*REMOTE), place(city=F.lit("Remote"), raw=s)).otherwise(
            place(
                city=F.get(parts, F.lit(0)),
                state=F.when((size == 2) & code.isNull(), F.coalesce(lookup(STATES, F.lower(second)), second)).when(size > 2, second).otherwise(nothing),
                country=F.when((size == 2) & code.isNotNull(), second).when((size == 2) & in_us, "United States").when(size > 2, third),
                country_code=F.when((size == 2) & code.isNotNull(), code).when((size == 2) & in_us, "US").when(size > 2, lookup(COUNTRIES, F.lower(third))),
                raw=s,
            )
        ),
    )


def filled(a: Column, b: Column) -> Column:
    """Every part of the first that isn't empty, else the second's."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(place(**{k: text_or(a[k], b[k]) for k in (*PARTS, "raw")}))


def completeness(p: Column) -> Column:
    """How many of the five parts are there."""
    return sum((F.when(p[k] != "", 1).otherwise(0) for k in PARTS), F.lit(0))


def display(p: Column) -> Column:
    """City, state and country, else the text it came from."""
    shown = null_if_empty(F.concat_ws(", ", *(null_if_empty(p[k]) for k in ("city", "state", "country"))))
    return F.coalesce(shown, p["raw"])
