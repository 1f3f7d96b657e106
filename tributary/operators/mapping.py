"""Extracted records to canonical ones: one projection, row by row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import contact, dates, places, skills, text
from tributary.functions.arrays import distinct_by, or_empty
from tributary.functions.dims import DEGREES, STILL
from tributary.functions.skills import alias_table, resolved
from tributary.sources.schema import CANONICAL, CERTIFICATION, EDUCATION, EXPERIENCE, LANGUAGE, PROJECT, RAW_LINK, SKILL, STRINGS

LONGEST_SUMMARY, LONGEST_JOB, LONGEST_PROJECT = 3000, 2000, 1000


def degree(c: Column) -> Column:
    """The degree that the first of the known words in the text tells; unknown without text, other without a known word."""
    low = F.lower(c)
    out = F.when(text.null_if_empty(c).isNull(), "unknown")
    for word, name in DEGREES:
        out = out.when(F.contains(low, F.lit(word)), name)
    return out.otherwise("other")


def gpa(c: Column) -> Column:
    """What stands before a slash, if it is a number from 0 to 4."""
    value = F.trim(F.split_part(c, F.lit("/"), F.lit(1))).try_cast("double")
    return F.when(value.between(0.0, 4.0), value)


def cleaned(a: Column) -> Column:
    return F.array_compact(F.transform(or_empty(a), text.clean))


def location(city: Column, state: Column, country: Column, postal_code: Column, raw: Column) -> Column:
    """Structured parts if there are any, else the parsed text."""
    given = F.concat_ws("", city, state, country) != ""
    structured = places.place(city=text.clean(city), state=text.clean(state), country=text.clean(country), postal_code=text.clean(postal_code), raw=raw)
    return F.when(given, structured).otherwise(places.parse_place(raw))


def skill_structs(names: Column) -> Column:
    none = F.lit(None)
    return F.transform(names, lambda n: F.struct(n.alias("canonical_name"), skills.aliases_of(n).alias("aliases"), F.lit("unknown").alias("level"), none.cast("double").alias("years_of_experience"), none.cast("string").alias("category"))).cast(f"array<{SKILL}>")


def job(x: Column, technologies: Column, as_of: Column) -> Column:
    current = F.coalesce(x["is_current"], F.lit(False)) | F.coalesce(F.lower(x["end_raw"]).isin(*STILL), F.lit(False))
    return F.struct(
        F.coalesce(text.null_if_empty(text.company_case(x["company"])), F.lit("Unknown")).alias("company"),
        F.coalesce(text.clean(x["title"]), F.lit("Unknown")).alias("title"),
        places.parse_place(x["location_raw"]).alias("location"),
        dates.parse_date(x["start_raw"], as_of).alias("start_date"),
        F.when(~current, dates.parse_date(x["end_raw"], as_of, end=True)).alias("end_date"),
        current.alias("is_current"),
        text.truncate(text.clean(x["description"]), LONGEST_JOB).alias("description"),
        cleaned(x["responsibilities"]).alias("responsibilities"),
        technologies.alias("technologies"),
        cleaned(x["achievements"]).alias("achievements"),
    )


def school(x: Column, as_of: Column) -> Column:
    return F.struct(
        F.coalesce(text.null_if_empty(text.company_case(x["institution"])), F.lit("Unknown")).alias("institution"),
        degree(x["degree_raw"]).alias("degree"),
        text.clean(x["field_of_study"]).alias("field_of_study"),
        dates.parse_date(x["start_raw"], as_of).alias("start_date"),
        dates.parse_date(x["end_raw"], as_of, end=True).alias("end_date"),
        gpa(x["gpa_raw"]).alias("gpa"),
        cleaned(x["honors"]).alias("honors"),
    )


def project(x: Column, technologies: Column, as_of: Column) -> Column:
    return F.struct(
        F.coalesce(text.clean(x["name"]), F.lit("Untitled")).alias("name"),
        text.truncate(text.clean(x["description"]), LONGEST_PROJECT).alias("description"),
        contact.normal_url(x["url"]).alias("url"),
        contact.normal_url(x["repository_url"]).alias("repository_url"),
        technologies.alias("technologies"),
        dates.parse_date(x["start_raw"], as_of).alias("start_date"),
        dates.parse_date(x["end_raw"], as_of, end=True).alias("end_date"),
        F.coalesce(x["is_open_source"], F.lit(False)).alias("is_open_source"),
        x["stars"].alias("stars"),
        x["forks"].alias("forks"),
    )


def certificate(x: Column, as_of: Column) -> Column:
    return F.struct(
        F.coalesce(text.clean(x["name"]), F.lit("Unknown")).alias("name"),
        text.clean(x["issuing_organization"]).alias("issuing_organization"),
        dates.parse_date(x["issue_raw"], as_of).alias("issue_date"),
        dates.parse_date(x["expiry_raw"], as_of, end=True).alias("expiry_date"),
        text.clean(x["credential_id"]).alias("credential_id"),
        contact.normal_url(x["credential_url"]).alias("credential_url"),
    )


def links(a: Column) -> Column:
    """Links with a valid URL, the first of each URL, platforms in lower case or ``other``."""
    each = F.transform(or_empty(a, f"array<{RAW_LINK}>"), lambda x: F.struct(contact.known_platform(F.coalesce(x["platform"], F.lit("other"))).alias("platform"), contact.normal_url(x["url"]).alias("url"), x["username"].alias("username")))
    return distinct_by(F.filter(each, lambda x: x["url"].isNotNull()), lambda x: x["url"])


def languages(a: Column) -> Column:
    kept = distinct_by(cleaned(a), F.lower)
    return F.transform(kept, lambda x: F.struct(text.title_case(x).alias("name"), F.lit(None).cast("string").alias("proficiency"))).cast(f"array<{LANGUAGE}>")


def normal_skill_lists(lists: Column) -> Column:
    """normal_skills() over an array of lists, in one call to Python per batch."""
    table = alias_table()
    known: dict[str, str] = {}

    def one(own) -> list[str]:
        out: dict[str, None] = {}
        for name in own if own is not None else ():
            if name is None:
                continue
            if name not in known:
                if len(known) > 100_000:
                    known.clear()
                known[name] = resolved(name, table)
            if known[name]:
                out[known[name]] = None
        return list(out)

    @F.pandas_udf(f"array<{STRINGS}>")
    def names(rows: pd.Series) -> pd.Series:
        return rows.map(lambda all_: [] if all_ is None else [one(own) for own in all_])

    # Said to be undetermined only so that the optimiser leaves the mapping above a union of sources, once, and not in each branch of it.
    return names.asNondeterministic()(lists)


def map_canonical(extracted: DataFrame, as_of: str | Column | None = None, compose: bool = False) -> DataFrame:
    """Canonical records of extracted ones without an error. as_of: the day that open ends mean (today if it isn't given); compose: bring names and prose into NFC first, which costs a pass through Python."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    df = extracted.where(F.col("error").isNull())
    if compose:
        df = df.withColumns({c: text.nfc(F.col(c)) for c in ("full_name", "first_name", "last_name", "summary", "headline")})
    lists = F.concat(
        F.array(or_empty(F.col("skills_raw"))),
        F.transform(F.col("experience"), lambda x: or_empty(x["technologies"])),
        F.transform(F.col("projects"), lambda x: or_empty(x["technologies"])),
    )
    full, first, last = (text.title_name(F.col(c)) for c in ("full_name", "first_name", "last_name"))
    df = df.withColumns({"_skills": normal_skill_lists(lists), "_first": first, "_last": last}).withColumn("_full", F.coalesce(full, text.null_if_empty(F.concat_ws(" ", "_first", "_last"))))
    parts = text.split_name(F.col("_full"))
    whole = F.col("_first").isNull() & F.col("_last").isNull()
    n_jobs = F.size("experience")
    made = {
        "full_name": F.col("_full"),
        "first_name": F.when(whole, parts["first"]).otherwise(F.col("_first")),
        "last_name": F.when(whole, parts["last"]).otherwise(F.col("_last")),
        "emails": contact.normal_emails(F.col("emails")),
        "phones": contact.normal_phones(F.col("phones")),
        "location": location(*(F.col(c) for c in ("city", "state", "country", "postal_code", "location_raw"))),
        "summary": text.truncate(text.clean(F.col("summary")), LONGEST_SUMMARY),
        "headline": text.clean(F.col("headline")),
        "skills": skill_structs(F.get("_skills", F.lit(0))),
        "experience": F.transform(F.col("experience"), lambda x, i: job(x, F.get(F.col("_skills"), i + 1), day)).cast(f"array<{EXPERIENCE}>"),
        "education": F.transform(F.col("education"), lambda x: school(x, day)).cast(f"array<{EDUCATION}>"),
        "projects": F.transform(F.col("projects"), lambda x, i: project(x, F.get(F.col("_skills"), i + 1 + n_jobs), day)).cast(f"array<{PROJECT}>"),
        "certifications": F.transform(F.col("certifications"), lambda x: certificate(x, day)).cast(f"array<{CERTIFICATION}>"),
        "social_links": links(F.col("social_links")),
        "languages": languages(F.col("languages")),
    }
    return df.select(*(made.get(n, F.col(n)).cast(k).alias(n) for n, k in CANONICAL.items()))

