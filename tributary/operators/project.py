"""Projection of merged records to configured output, and its JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import dates, places

# Fields of the output in its order, and those that are shown unless a configuration names others.
ORDER = (
    "candidate_id", "full_name", "first_name", "last_name", "middle_name", "preferred_name", "emails", "phones", "location", "summary", "headline", "years_of_experience",
    "skills", "experience", "education", "projects", "certifications", "social_links", "languages", "confidence", "provenance", "metadata",
)
DEFAULT = tuple(f for f in ORDER if f not in ("middle_name", "preferred_name", "headline", "years_of_experience"))
FLAGS = {"confidence": "include_confidence", "provenance": "include_provenance", "metadata": "include_metadata"}


@dataclass(frozen=True)
class OutputConfig:
    """What is shown and how. confidence_threshold leaves out fields that score lower; at 0 it does nothing."""

    output_fields: tuple[str, ...] = DEFAULT
    include_provenance: bool = True
    include_confidence: bool = True
    include_metadata: bool = True
    null_handling: str = "omit"
    date_format: str = "ISO8601"
    confidence_threshold: float = 0.0
    output_format: str = "json"

    @classmethod
    def of(cls, given: dict) -> OutputConfig:
        known = {f.name: given[f.name] for f in fields(cls) if f.name in given}
        return cls(**known | {"output_fields": tuple(known.get("output_fields") or DEFAULT)})

    @classmethod
    def read(cls, path: str | Path) -> OutputConfig:
        """A configuration of a JSON file; ValueError if it can't be read as one."""
        try:
            given = json.loads(Path(path).read_text())
        except (OSError, ValueError) as e:
            raise ValueError(f"no output configuration in {path}: {e}") from e
        if not isinstance(given, dict):
            raise ValueError(f"no output configuration in {path}: not an object")
        return cls.of(given)

    @property
    def shown(self) -> list[str]:
        """Fields in the order of records, whatever order they are named in."""
        wanted = {"candidate_id", *self.output_fields}
        return [f for f in ORDER if f in wanted and getattr(self, FLAGS.get(f, ""), True)]


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def time_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def renamed(x: Column, **parts: Column | str) -> Column:
    return F.struct(*((x[v] if isinstance(v, str) else v).alias(k) for k, v in parts.items()))


def shown_place(p: Column) -> Column:
    return F.when(p.isNotNull(), renamed(p, city="city", state="state", country="country", country_code="country_code", postal_code="postal_code", display=places.display(p)))


def shown_job(x: Column, as_of: Column) -> Column:
    return renamed(
        x, company="company", title="title", location=shown_place(x["location"]), start_date=date_text(x["start_date"]), end_date=date_text(x["end_date"]), is_current="is_current",
        duration_months=dates.duration_months(x["start_date"], x["end_date"], x["is_current"], as_of), description="description", responsibilities="responsibilities",
        technologies="technologies", achievements="achievements",
    )


def output_fields(as_of: Column) -> dict[str, Column]:
    """Every field of the output as an expression over a merged record."""
    each = lambda name, f: F.transform(F.col(name), f)
    none = F.lit(None).cast("string")
    return {
        "candidate_id": F.sha2(F.col("entity_id"), 256),
        **{n: F.col(n) for n in ("full_name", "first_name", "last_name", "emails", "phones", "summary", "headline", "years_of_experience")},
        "middle_name": none,
        "preferred_name": none,
        "location": shown_place(F.col("location")),
        "skills": each("skills", lambda x: renamed(x, name="canonical_name", level="level", years_of_experience="years_of_experience", category="category")),
        "experience": each("experience", lambda x: shown_job(x, as_of)),
        "education": each("education", lambda x: renamed(x, institution="institution", degree="degree", field_of_study="field_of_study", start_date=date_text(x["start_date"]), end_date=date_text(x["end_date"]), gpa="gpa", honors="honors")),
        "projects": each(
            "projects",
            lambda x: renamed(x, name="name", description="description", url="url", repository_url="repository_url", technologies="technologies", is_open_source="is_open_source", stars="stars", forks="forks", start_date=date_text(x["start_date"]), end_date=date_text(x["end_date"])),
        ),
        "certifications": each("certifications", lambda x: renamed(x, name="name", issuing_organization="issuing_organization", issue_date=date_text(x["issue_date"]), expiry_date=date_text(x["expiry_date"]), credential_id="credential_id", credential_url="credential_url")),
        "social_links": F.col("social_links"),
        "languages": F.col("languages"),
        "confidence": F.struct(
            F.col("confidence.overall_score").alias("overall_score"),
            F.col("confidence.sources_used").alias("sources_used"),
            F.col("confidence.high_confidence_fields").alias("high_confidence_fields"),
            F.col("confidence.low_confidence_fields").alias("low_confidence_fields"),
            F.transform_values("confidence.fields", lambda _, f: F.struct(f["score"].alias("score"), f["explanation"].alias("explanation"))).alias("fields"),
        ),
        "provenance": each(
            "provenance",
            lambda p: F.struct(
                p["field_name"].alias("field"), p["selected"]["source"].alias("source"), p["selected"]["extraction_method"].alias("method"), p["selected"]["confidence"].alias("confidence"),
                p["conflict_resolved"].alias("conflict_resolved"), p["resolution_reason"].alias("resolution_reason"), F.size(p["candidates"]).alias("candidate_count"),
            ),
        ),
        "metadata": F.col("metadata"),
    }


def project(records: DataFrame, config: OutputConfig = OutputConfig(), as_of: str | Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, columns to carry along, and the shown fields. Only they are built: what isn't shown is never merged, as Catalyst prunes it."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    every = output_fields(day)
    shown = [n for n in config.shown if n != "metadata" or "metadata" in records.columns]
    chosen = {n: every[n] for n in shown}
    if config.confidence_threshold > 0:
        for n in chosen:
            if n not in ("candidate_id", "confidence", "provenance", "metadata"):
                low = F.coalesce(F.try_element_at(F.col("confidence.fields"), F.lit(n))["score"] < config.confidence_threshold, F.lit(False))
                chosen[n] = F.when(~low, chosen[n])
    return records.select("entity_id", *carry, *(c.alias(n) for n, c in chosen.items()))


def member(c: Column, kind: str, null_handling: str) -> Column:
    """A field's JSON: null where it is to be left out."""
    if kind == "string":
        # A string's JSON is that of a struct around it without the struct's own signs.
        as_json = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    elif kind.startswith(("array", "struct", "map")):
        as_json = F.to_json(c, {"ignoreNullFields": "false"})
    else:
        as_json = c.cast("string")
    if null_handling == "omit":
        return F.when(F.size(c) > 0, as_json) if kind.startswith(("array", "map")) else F.when(c.isNotNull(), as_json)
    return F.coalesce(F.when(c.isNotNull(), as_json), F.lit('""' if null_handling == "empty" else "null"))


def render(projected: DataFrame, config: OutputConfig = OutputConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, carried columns, json): the shown fields as one object; null handling holds for its members, not inside them."""
    kinds = dict(projected.dtypes)
    names = [n for n in projected.columns if n not in ("entity_id", *carry)]
    parts = [F.when(m.isNotNull(), F.concat(F.lit(f'"{n}":'), m)) for n in names for m in [member(F.col(n), kinds[n], config.null_handling)]]
    return projected.select("entity_id", *carry, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def pretty(json_text: str) -> bytes:
    """One record as it is written for people: two spaces, UTF-8."""
    return json.dumps(json.loads(json_text), indent=2, ensure_ascii=False).encode()
