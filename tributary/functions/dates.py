"""Dates as résumés write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.arrays import bound
from tributary.functions.dims import MONTHS, PRESENT, lookup

MONTH_OF = {m: i + 1 for i, m in enumerate(MONTHS)}


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date of numbers as strings; null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    return lookup(MONTH_OF, F.lower(F.substring(name, 1, 3)))


def parse_date(c: Column, as_of: Column, end: bool = False) -> Column:
    """A date, with day or month 1 where the text has none. Words for an open end give as_of for an end date, else null; months come before days, unless over 12."""
    return bound(F.trim(c), lambda s: parsed(s, as_of, end))


def parsed(s: Column, as_of: Column, end: bool) -> Column:
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    quarter, month_year = r"(?i)^Q([1-4])\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{4})$"
    iso, iso_month = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{4})[-/.](\d{1,2})$"
    numeric, numeric_month = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", r"^(\d{1,2})[-/.](\d{4})$"
    month_first, day_first = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", r"^(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})$"
    comma_month = r"^([A-Za-z]{3,9})\.?,?\s+(\d{4})$"
    year = F.when(s.rlike(r"^\d{4}$"), F.try_to_number(s, F.lit("9999")).cast("int"))
    one = F.lit("1")
    first = F.try_to_number(part(numeric, 1), F.lit("99")).cast("int")
    return (
        F.when(F.lower(s).isin(*PRESENT), as_of if end else F.lit(None).cast("date"))
        .when(s.rlike(quarter), ymd(part(quarter, 2), (part(quarter, 1).cast("int") - 1) * 3 + 1, one))
        .when(s.rlike(month_year) & month_number(part(month_year, 1)).isNotNull(), ymd(part(month_year, 2), month_number(part(month_year, 1)), one))
        .when(year.isNotNull(), F.when(year.between(1950, F.year(as_of) + 5), ymd(s, one, one)))
        .when(s.rlike(iso), ymd(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike(iso_month), ymd(part(iso_month, 1), part(iso_month, 2), one))
        .when(s.rlike(numeric), F.when(first > 12, ymd(part(numeric, 3), part(numeric, 2), part(numeric, 1))).otherwise(ymd(part(numeric, 3), part(numeric, 1), part(numeric, 2))))
        .when(s.rlike(numeric_month), ymd(part(numeric_month, 2), part(numeric_month, 1), one))
        .when(s.rlike(month_first), ymd(part(month_first, 3), month_number(part(month_first, 1)), part(month_first, 2)))
        .when(s.rlike(day_first), ymd(part(day_first, 3), month_number(part(day_first, 2)), part(day_first, 1)))
        .when(s.rlike(comma_month), ymd(part(comma_month, 2), month_number(part(comma_month, 1)), one))
    )


# What separates the ends of a range, first match wins.
RANGE_SEPARATORS = (" – ", " - ", " to ", "–", "-", "/", "~")


def parse_range(c: Column, as_of: Column) -> Column:
    """struct(start, end, current); without a separator the start alone."""
    start, end = c, F.lit(None).cast("string")
    for s in reversed(RANGE_SEPARATORS):
        has, at = F.contains(c, F.lit(s)), F.instr(c, s)
        start = F.when(has, F.substring(c, F.lit(1), at - 1)).otherwise(start)
        end = F.when(has, F.substring(c, at + len(s), F.length(c))).otherwise(end)
    current = F.coalesce(F.lower(F.trim(end)).isin(*PRESENT), F.lit(False))
    return F.struct(parse_date(start, as_of).alias("start"), parse_date(end, as_of, end=True).alias("end"), current.alias("current"))


def duration_months(start: Column, end: Column, current: Column, as_of: Column) -> Column:
    """Whole months between the months of two dates; an entry that goes on ends at as_of."""
    stop = F.when(current, F.coalesce(end, as_of)).otherwise(end)
    return F.when(start.isNotNull() & stop.isNotNull(), F.greatest(F.lit(0), (F.year(stop) - F.year(start)) * 12 + F.month(stop) - F.month(start)))
