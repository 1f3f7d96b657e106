"""The schema that every source is read into, and the canonical one it is mapped to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.places import PLACE

STRINGS = "array<string>"
RAW_EXPERIENCE = f"struct<company: string, title: string, location_raw: string, start_raw: string, end_raw: string, is_current: boolean, description: string, responsibilities: {STRINGS}, technologies: {STRINGS}, achievements: {STRINGS}>"
RAW_EDUCATION = f"struct<institution: string, degree_raw: string, field_of_study: string, start_raw: string, end_raw: string, gpa_raw: string, honors: {STRINGS}>"
RAW_PROJECT = f"struct<name: string, description: string, url: string, repository_url: string, technologies: {STRINGS}, start_raw: string, end_raw: string, is_open_source: boolean, stars: int, forks: int>"
RAW_CERTIFICATION = "struct<name: string, issuing_organization: string, issue_raw: string, expiry_raw: string, credential_id: string, credential_url: string>"
RAW_LINK = "struct<platform: string, url: string, username: string>"

#: What a source gives of one entity. error: why it gives nothing.
EXTRACTED = {
    "entity_id": "string", "source": "string", "raw_path": "string", "full_name": "string", "first_name": "string", "last_name": "string",
    "emails": STRINGS, "phones": STRINGS, "location_raw": "string", "city": "string", "state": "string", "country": "string", "postal_code": "string",
    "summary": "string", "headline": "string", "years_of_experience": "double", "skills_raw": STRINGS, "experience": f"array<{RAW_EXPERIENCE}>",
    "education": f"array<{RAW_EDUCATION}>", "projects": f"array<{RAW_PROJECT}>", "certifications": f"array<{RAW_CERTIFICATION}>",
    "social_links": f"array<{RAW_LINK}>", "languages": STRINGS, "extras": "map<string, string>", "error": "string",
}

SKILL = f"struct<canonical_name: string, aliases: {STRINGS}, level: string, years_of_experience: double, category: string>"
EXPERIENCE = f"struct<company: string, title: string, location: {PLACE}, start_date: date, end_date: date, is_current: boolean, description: string, responsibilities: {STRINGS}, technologies: {STRINGS}, achievements: {STRINGS}>"
EDUCATION = f"struct<institution: string, degree: string, field_of_study: string, start_date: date, end_date: date, gpa: double, honors: {STRINGS}>"
PROJECT = f"struct<name: string, description: string, url: string, repository_url: string, technologies: {STRINGS}, start_date: date, end_date: date, is_open_source: boolean, stars: int, forks: int>"
CERTIFICATION = "struct<name: string, issuing_organization: string, issue_date: date, expiry_date: date, credential_id: string, credential_url: string>"
LANGUAGE = "struct<name: string, proficiency: string>"

#: One source's view of an entity, normalised; the merged record has the same fields without source.
CANONICAL = {
    "entity_id": "string", "source": "string", "full_name": "string", "first_name": "string", "last_name": "string", "emails": STRINGS, "phones": STRINGS,
    "location": PLACE, "summary": "string", "headline": "string", "years_of_experience": "double", "skills": f"array<{SKILL}>",
    "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "projects": f"array<{PROJECT}>", "certifications": f"array<{CERTIFICATION}>",
    "social_links": f"array<{RAW_LINK}>", "languages": f"array<{LANGUAGE}>",
}


def as_extracted(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The columns given, all others of the schema null or empty; an entity with an error gives nothing else."""
    columns = {"source": F.lit(source)} | columns
    failed = columns.get("error", F.lit(None).cast("string"))
    always = ("entity_id", "source", "raw_path", "error")

    def one(name: str, kind: str) -> Column:
        value = columns.get(name, F.lit(None)).cast(kind)
        if name in always:
            return value.alias(name)
        value = F.when(failed.isNull(), value)
        return (F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value).alias(name)

    return df.select(*(one(n, k) for n, k in EXTRACTED.items()))
