"""Provenance of every field, and the confidence that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import dims
from tributary.operators.merge import LISTS, SCALARS, compared, conflicting, with_value

# How values are taken, and why they are selected.
METHOD = "direct_field_mapping"
SELECTED = "Selected value from highest-priority source '"
DISAGREED, NO_CONFLICT = " sources disagreed)", "(no conflict)"
FILLED = "Merged all location sources, filling missing fields"
UNION = "Union merge across all sources with deduplication"
CANDIDATE = "struct<source: string, extraction_method: string, value: string, confidence: double>"
PROVENANCE = f"struct<field_name: string, selected: {CANDIDATE}, candidates: array<{CANDIDATE}>, conflict_resolved: boolean, resolution_reason: string>"
CONFIDENCE = "struct<field_name: string, score: double, base_score: double, agreement_bonus: double, disagreement_penalty: double, sources_agreed: int, sources_disagreed: int, explanation: string>"


def candidate(source: Column, value: Column, confidence: Column) -> Column:
    return F.struct(source.alias("source"), F.lit(METHOD).alias("extraction_method"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence")).cast(CANDIDATE)


def shown(v: Column, field: str) -> Column:
    return F.to_json(v, {"ignoreNullFields": "false"}) if field == "location" else v.cast("string")


def scalar_provenance(records: Column, field: str) -> Column:
    """Where a single value comes from and what other sources say; null if no source has one."""
    held = with_value(records, field)
    each = F.transform(held, lambda r: candidate(r["source"], shown(r[field], field), dims.weight(r["source"])))
    conflict = conflicting(F.transform(held, lambda r: r[field].cast("string")))
    first = F.get(each, F.lit(0))
    reason = F.concat(
        F.lit(SELECTED), first["source"], F.lit("' "), F.when(conflict, F.concat(F.lit("(conflict: "), F.size(held).cast("string"), F.lit(DISAGREED))).otherwise(NO_CONFLICT)
    )
    return F.when(F.size(held) > 0, F.struct(F.lit(field).alias("field_name"), first.alias("selected"), each.alias("candidates"), conflict.alias("conflict_resolved"), reason.alias("resolution_reason")).cast(PROVENANCE))


def location_provenance(records: Column, merged: Column) -> Column:
    """As of a single value, but the merged location is the one selected and no conflict is flagged."""
    held = with_value(records, "location")
    each = F.transform(held, lambda r: candidate(r["source"], shown(r["location"], "location"), dims.weight(r["source"])))
    first = F.get(held, F.lit(0))["source"]
    chosen = candidate(first, shown(merged, "location"), dims.weight(first))
    reason = F.lit(FILLED)
    return F.when(F.size(held) > 0, F.struct(F.lit("location").alias("field_name"), chosen.alias("selected"), each.alias("candidates"), F.lit(False).alias("conflict_resolved"), reason.alias("resolution_reason")).cast(PROVENANCE))


def list_provenance(field: str, values: Column) -> Column:
    """Lists are unions of all sources: no source is selected and none competes."""
    chosen = candidate(F.lit("unknown"), F.to_json(values), F.lit(1.0))
    none = F.array().cast(f"array<{CANDIDATE}>")
    reason = F.lit(UNION)
    return F.struct(F.lit(field).alias("field_name"), chosen.alias("selected"), none.alias("candidates"), F.lit(False).alias("conflict_resolved"), reason.alias("resolution_reason")).cast(PROVENANCE)


def list_values(field: str) -> Column:
    """What a list's provenance shows of it."""
    c = F.col(field)
    if field in ("emails", "phones"):
        return c
    if field == "experience":
        return F.transform(c, lambda x: F.concat_ws(" | ", x["company"], x["title"]))
    if field == "social_links":
        return F.transform(c, lambda x: F.concat_ws(":", x["platform"], x["url"]))
    key = {"skills": "canonical_name", "education": "institution", "projects": "name", "certifications": "name"}[field]
    return F.transform(c, lambda x: x[key])


#: Column of with_provenance() with the entries of single values alone, which with_confidence() reads and drops.
SINGLE = "_single_provenance"


def with_provenance(merged: DataFrame) -> DataFrame:
    """The merged records with ``provenance``, an entry a field in order of the merge."""
    records = F.col("records")
    single = F.array_compact(F.array(*(scalar_provenance(records, f) for f in SCALARS), location_provenance(records, F.col("location"))))
    lists = F.array(*(list_provenance(f, list_values(f)) for f in LISTS))
    return merged.withColumn(SINGLE, single).withColumn("provenance", F.concat(SINGLE, lists))


def scored(p: Column) -> Column:
    """A field's confidence: its source's weight, more for each other source that agrees, less for each that doesn't."""
    base, won = dims.weight(p["selected"]["source"]), compared(p["selected"]["value"])
    said = F.transform(p["candidates"], lambda c: compared(c["value"]))
    agreed = F.greatest(F.lit(0), F.size(F.filter(said, lambda v: v == won)) - 1)
    disagreed = F.size(F.filter(said, lambda v: v != won))
    return confidence_of(p["field_name"], p["selected"]["source"], base, agreed, disagreed)


def score(base: Column, agreed: Column, disagreed: Column) -> Column:
    raw = base + F.lit(dims.AGREEMENT) * agreed - F.lit(dims.DISAGREEMENT) * disagreed
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def confidence_of(field: Column, source: Column, base: Column, agreed: Column, disagreed: Column) -> Column:
    bonus, penalty = F.round(F.lit(dims.AGREEMENT) * agreed, 4), F.round(F.lit(dims.DISAGREEMENT) * disagreed, 4)
    explained = F.concat(
        F.format_string("Base: %.2f (source=%s)", base, source),
        F.when(bonus > 0, F.format_string(" +%.2f (agreement)", bonus)).otherwise(""),
        F.when(penalty > 0, F.format_string(" -%.2f (conflict)", penalty)).otherwise(""),
    )
    return F.struct(
        field.alias("field_name"),
        score(base, agreed, disagreed).alias("score"),
        base.alias("base_score"),
        bonus.alias("agreement_bonus"),
        penalty.alias("disagreement_penalty"),
        agreed.cast("int").alias("sources_agreed"),
        disagreed.cast("int").alias("sources_disagreed"),
        explained.alias("explanation"),
    ).cast(CONFIDENCE)


def presence(field: str, there: Column) -> Column:
    """Confidence of a field without provenance: the first source's weight if it is there, else 0."""
    base = dims.weight(F.get(F.col("sources"), F.lit(0)))
    zero, text = F.lit(0.0), F.when(there, "present").otherwise("missing")
    return F.struct(F.lit(field), F.when(there, F.round(base, 4)).otherwise(0.0), base, zero, zero, F.lit(0), F.lit(0), F.concat(F.lit("Presence-based: "), text)).cast(CONFIDENCE)


def overall(fields: Column) -> Column:
    """Mean of the fields' scores, weighed by their importance."""
    total = lambda of: F.reduce(F.transform(fields, of), F.lit(0.0), lambda a, x: a + x)
    weights = total(lambda f: dims.importance(f["field_name"]))
    return F.when(weights > 0, F.round(total(lambda f: f["score"] * dims.importance(f["field_name"])) / weights, 4)).otherwise(0.0)


def with_confidence(merged: DataFrame) -> DataFrame:
    """The merged records with ``confidence``: overall score, fields, names of high and low ones, sources."""
    # A list's score doesn't hang on what the list holds, so that scores alone need no list.
    none = F.lit(0)
    lists = F.array(*(confidence_of(F.lit(f), F.lit("unknown"), dims.weight(F.lit("unknown")), none, none) for f in LISTS))
    explained = F.concat(F.transform(F.col(SINGLE), scored), lists) if SINGLE in merged.columns else F.transform(F.col("provenance"), scored)
    missing = F.when(~F.exists(SINGLE if SINGLE in merged.columns else "provenance", lambda p: p["field_name"] == "full_name"), presence("full_name", F.coalesce(F.col("full_name") != "", F.lit(False))))
    df = merged.withColumn("_fields", F.array_compact(F.concat(explained, F.array(missing))))
    fields = F.col("_fields")
    names = lambda test: F.array_sort(F.transform(F.filter(fields, test), lambda f: f["field_name"]))
    made = F.struct(
        overall(fields).alias("overall_score"),
        F.map_from_entries(F.transform(fields, lambda f: F.struct(f["field_name"], f))).alias("fields"),
        names(lambda f: f["score"] >= dims.HIGH).alias("high_confidence_fields"),
        names(lambda f: f["score"] < dims.LOW).alias("low_confidence_fields"),
        F.col("sources").alias("sources_used"),
    )
    return df.withColumn("confidence", made).drop("_fields", SINGLE)
