"""Validation: rules that give findings, one row each, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import contact

FINDING = "struct<severity: string, field: string, message: string, value: string>"
# Severities, the earliest day a job may begin, and what findings say.
ERROR, WARNING = "error", "warning"
EARLIEST = "1950-01-01"
NO_NAME = "Candidate has no name (full_name or first_name+last_name required)"
NO_CONTACT = "No email addresses or phone numbers found"
BAD_EMAIL = "Invalid email address format"
BAD_PHONE = "Phone number is not in E.164 format"
TOO_EARLY = "Unrealistic start date"
ENDS_FIRST = "End date is before start date"
IN_FUTURE = "Start date is in the future"
LEFT_FIRST = "Graduation date is before enrollment date"
BAD_GPA = "GPA must be between 0.0 and 4.0"
BAD_LINK = "Social link URL is malformed"
NOT_FILLED = "Recommended field '{}' is empty or missing"


def finding(severity: str, field: Column | str, message: str, value: Column | None = None) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(severity).alias("severity"), field.alias("field"), F.lit(message).alias("message"), (F.lit(None) if value is None else value).cast("string").alias("value")).cast(FINDING)


def when(test: Column, found: Column) -> Column:
    """An array of the finding, empty where the test isn't true."""
    return F.when(test, F.array(found)).otherwise(F.array().cast(f"array<{FINDING}>"))


def missing(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def has_name(_: Column) -> Column:
    named = ~missing(F.col("full_name")) | (~missing(F.col("first_name")) & ~missing(F.col("last_name")))
    return when(~named, finding(ERROR, "full_name", NO_NAME))


def has_contact(_: Column) -> Column:
    return when((F.size("emails") == 0) & (F.size("phones") == 0), finding(WARNING, "contact", NO_CONTACT))


def emails_valid(_: Column) -> Column:
    bad = F.filter("emails", lambda e: ~contact.is_email(e))
    return F.transform(bad, lambda e: finding(ERROR, "emails", BAD_EMAIL, e))


def phones_valid(_: Column) -> Column:
    bad = F.filter("phones", lambda p: ~p.rlike(contact.E164))
    return F.transform(bad, lambda p: finding(WARNING, "phones", BAD_PHONE, p))


def place_in(name: str, i: Column, of: Column, what: str) -> Column:
    return F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("] ("), of, F.lit(f").{what}"))


def job_dates(as_of: Column) -> Column:
    def each(x: Column, i: Column) -> Column:
        start, end = x["start_date"], x["end_date"]
        at = lambda what: place_in("experience", i, x["company"], what)
        span = F.concat_ws(" > ", start.cast("string"), end.cast("string"))
        return F.concat(
            when(start < F.lit(EARLIEST).cast("date"), finding(WARNING, at("start_date"), TOO_EARLY, start)),
            when(end < start, finding(ERROR, at("dates"), ENDS_FIRST, span)),
            when(start > as_of, finding(WARNING, at("start_date"), IN_FUTURE, start)),
        )

    return F.flatten(F.transform("experience", each))


def school_dates(_: Column) -> Column:
    def each(x: Column, i: Column) -> Column:
        span = F.concat_ws(" > ", x["start_date"].cast("string"), x["end_date"].cast("string"))
        return when(x["end_date"] < x["start_date"], finding(ERROR, place_in("education", i, x["institution"], "dates"), LEFT_FIRST, span))

    return F.flatten(F.transform("education", each))


def gpa_range(_: Column) -> Column:
    def each(x: Column, i: Column) -> Column:
        return when(~x["gpa"].between(0.0, 4.0), finding(ERROR, F.concat(F.lit("education["), i.cast("string"), F.lit("].gpa")), BAD_GPA, x["gpa"]))

    return F.flatten(F.transform("education", each))


def links_valid(_: Column) -> Column:
    def each(x: Column, i: Column) -> Column:
        return when(~contact.is_url(x["url"]), finding(WARNING, F.concat(F.lit("social_links["), i.cast("string"), F.lit("].url")), BAD_LINK, x["url"]))

    return F.flatten(F.transform("social_links", each))


def complete(_: Column) -> Column:
    def rule(name: str, empty: Column) -> Column:
        return when(empty, finding(WARNING, name, NOT_FILLED.format(name)))

    return F.concat(rule("summary", missing(F.col("summary"))), *(rule(n, F.size(n) == 0) for n in ("skills", "experience", "education")))


#: Rules in the order of their findings; a new rule is one more function of the day.
RULES: list[Callable[[Column], Column]] = [has_name, has_contact, emails_valid, phones_valid, job_dates, school_dates, gpa_range, links_valid, complete]


def with_findings(records: DataFrame, as_of: str | Column | None = None, strict: bool = False, rules: list[Callable[[Column], Column]] = RULES) -> DataFrame:
    """The records with ``findings``; strict: warnings count as errors."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    found = F.concat(*(rule(day) for rule in rules))
    if strict:
        found = F.transform(found, lambda f: f.withField("severity", F.lit(ERROR)))
    return records.withColumn("findings", found)


def findings_rows(validated: DataFrame) -> DataFrame:
    """One row per finding."""
    return validated.select("entity_id", F.posexplode("findings").alias("seq", "f")).select("entity_id", "seq", "f.*")


def summary(validated: DataFrame) -> DataFrame:
    """One row per entity: numbers of errors and warnings, and whether it is valid."""
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    return validated.select("entity_id", count(ERROR).alias("errors"), count(WARNING).alias("warnings"), (count(ERROR) == 0).alias("is_valid"))
