"""JSON documents, one entity each, with fields under any of several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.arrays import clean_list, no_strings, string_list
from tributary.functions.text import null_if_empty
from tributary.sources.delimited import fields, row_id
from tributary.sources.schema import RAW_CERTIFICATION, RAW_EDUCATION, RAW_EXPERIENCE, RAW_LINK, RAW_PROJECT, as_extracted

# Keys of each field in the order they are tried. [] marks a list of strings, ? a flag, # a number.
KEYS = {
    "full_name": ("full_name", "name", "candidate_name", "fullName"),
    "first_name": ("first_name", "firstName", "given_name"),
    "last_name": ("last_name", "lastName", "surname", "family_name"),
    "emails[]": ("emails", "email_addresses", "email"),
    "phones[]": ("phones", "phone_numbers", "phone"),
    "location_raw": ("location", "address", "city"),
    "summary": ("summary", "bio", "about", "profile_summary"),
    "headline": ("headline", "title", "current_role"),
    "years_of_experience": ("years_of_experience", "years_experience", "experience_years"),
    "skills_raw[]": ("skills", "skill_set", "technologies"),
    "languages[]": ("languages",),
}
EXPERIENCE_KEYS = {
    "company": ("company", "employer", "organization"),
    "title": ("title", "position", "role", "job_title"),
    "location_raw": ("location", "city"),
    "start_raw": ("start_date", "startDate", "from"),
    "end_raw": ("end_date", "endDate", "to"),
    "is_current?": ("is_current", "current"),
    "description": ("description", "summary"),
    "responsibilities[]": ("responsibilities", "duties", "description_bullets"),
    "technologies[]": ("technologies", "tech_stack", "tools"),
    "achievements[]": ("achievements", "accomplishments"),
}
EDUCATION_KEYS = {
    "institution": ("institution", "school", "university", "college"),
    "degree_raw": ("degree", "degree_type", "level"),
    "field_of_study": ("field_of_study", "major", "discipline"),
    "start_raw": ("start_date", "startDate"),
    "end_raw": ("end_date", "endDate", "graduation_date"),
    "gpa_raw": ("gpa", "grade"),
    "honors[]": ("honors", "awards"),
}
PROJECT_KEYS = {
    "name": ("name", "title"),
    "description": ("description",),
    "url": ("url", "demo_url", "live_url"),
    "repository_url": ("repository_url", "repo_url", "github_url"),
    "technologies[]": ("technologies", "tech"),
    "start_raw": ("start_date",),
    "end_raw": ("end_date",),
    "is_open_source?": ("is_open_source", "open_source"),
    "stars#": ("stars",),
    "forks#": ("forks",),
}
CERTIFICATION_KEYS = {
    "name": ("name", "title", "certification_name"),
    "issuing_organization": ("issuing_organization", "issuer", "organization"),
    "issue_raw": ("issue_date", "issued_date", "date"),
    "expiry_raw": ("expiry_date", "expiration_date", "expires"),
    "credential_id": ("credential_id", "license_number"),
    "credential_url": ("credential_url", "url", "verify_url"),
}
EXTRA_KEYS = {
    "external_id": ("id", "candidate_id", "ats_id"),
    "status": ("status", "application_status", "stage"),
}
#: Endings of files that hold a document a line.
LINES = (".jsonl", ".ndjson")


def value(v: Column, keys: Sequence[str]) -> Column:
    """The first of the keys' values that isn't null, as text."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in keys))


def strings(v: Column, keys: Sequence[str]) -> Column:
    """The first key that has a value, as a list: arrays element by element, a string split at commas and semicolons."""
    out = no_strings()
    for k in reversed(keys):
        whole, text = F.try_variant_get(v, f"$.{k}", "array<string>"), F.try_variant_get(v, f"$.{k}", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        out = F.when(whole.isNotNull(), clean_list(F.array_compact(whole))).when(kind == "STRING", string_list(text)).when(text.isNotNull(), no_strings()).otherwise(out)
    return out


def truth(v: Column, keys: Sequence[str]) -> Column:
    text = F.lower(value(v, keys))
    return F.coalesce(~text.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))


def items(v: Column, keys: Sequence[str]) -> Column:
    """Objects of the first list that isn't empty; other elements are left out."""
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys]
    out = F.array().cast("array<variant>")
    for a in reversed(lists):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return F.filter(out, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def record(v: Column, keys: dict[str, Sequence[str]], struct: str) -> Column:
    """One object as a struct."""
    made = {}
    for name, own in keys.items():
        bare = name.rstrip("[]?#")
        made[bare] = strings(v, own) if name.endswith("]") else truth(v, own) if name.endswith("?") else value(v, own).try_cast("int") if name.endswith("#") else value(v, own)
    return F.struct(*(made.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields(struct)))


def from_json_rows(rows: DataFrame, entity: Column, path: Column, text: Column) -> DataFrame:
    """Extracted records of JSON texts, one a row; a text that is no JSON object gives an error."""
    parsed = rows.withColumns({"_doc": F.try_parse_json(text), "_path": path, "_entity": entity, "_text": text})
    v = F.col("_doc")
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    error = F.when(v.isNull(), F.concat(F.lit("[ats] invalid JSON: "), F.col("_path"))).when(~is_object, F.concat(F.lit("[ats] not a JSON object: "), F.col("_path")))
    simple = {n: value(v, k) for n, k in KEYS.items() if not n.endswith("]")}
    lists = {n.rstrip("[]"): strings(v, k) for n, k in KEYS.items() if n.endswith("]")}
    place = {k: F.try_variant_get(v, f"$.location_structured.{k}", "string") for k in ("city", "state", "country")}
    given = F.transform(
        F.coalesce(F.try_variant_get(v, "$.social_links", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.struct(F.try_variant_get(x, "$.platform", "string").alias("platform"), F.try_variant_get(x, "$.url", "string").alias("url"), F.try_variant_get(x, "$.username", "string").alias("username")),
    )
    link = lambda platform, keys: F.when(null_if_empty(value(v, keys)).isNotNull(), F.struct(F.lit(platform).alias("platform"), value(v, keys).alias("url"), F.lit(None).cast("string").alias("username")))
    links = F.concat(given.cast(f"array<{RAW_LINK}>"), F.array_compact(F.array(link("linkedin", ("linkedin_url", "linkedin")), link("github", ("github_url", "github")))).cast(f"array<{RAW_LINK}>"))
    years = simple.pop("years_of_experience").try_cast("double")
    return as_extracted(
        parsed,
        "ats",
        entity_id=F.col("_entity"),
        raw_path=F.col("_path"),
        **{n: (null_if_empty(c) if n in ("location_raw", "summary", "headline") else c) for n, c in simple.items()},
        **lists,
        **place,
        years_of_experience=years,
        experience=F.transform(items(v, ("experience", "work_experience")), lambda x: record(x, EXPERIENCE_KEYS, RAW_EXPERIENCE)),
        education=F.transform(items(v, ("education",)), lambda x: record(x, EDUCATION_KEYS, RAW_EDUCATION)),
        projects=F.transform(items(v, ("projects",)), lambda x: record(x, PROJECT_KEYS, RAW_PROJECT)),
        certifications=F.transform(items(v, ("certifications", "certificates")), lambda x: record(x, CERTIFICATION_KEYS, RAW_CERTIFICATION)),
        social_links=links,
        extras=F.map_filter(F.create_map(*(c for n, k in EXTRA_KEYS.items() for c in (F.lit(n), value(v, k)))), lambda _, x: x.isNotNull()),
        error=error,
    )


def read_documents(spark: SparkSession, path: str, entity: Column | None = None, lines: bool | None = None) -> DataFrame:
    """Extracted records of JSON files, one document a file, or one a line in files of JSON lines; unless told, a path tells by its ending."""
    if lines is None:
        lines = path.lower().rstrip("/").endswith(LINES)
    found = spark.read.text(path, wholetext=not lines).withColumn("_file", F.input_file_name())
    if lines:
        found = found.where(F.trim("value") != "")
    own = row_id(F.col("_file"), F.col("value")) if lines else F.col("_file")
    return from_json_rows(found, entity if entity is not None else own, F.col("_file"), F.col("value"))
