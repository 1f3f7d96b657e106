"""Merge: all sources' records of an entity into one, in order of priority.

One shuffle brings an entity's records together, at most one a source; what
follows are expressions over that short array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import dims, places
from tributary.functions.arrays import distinct_by, list_or, number_or, text_or
from tributary.functions.similarity import leader_positions
from tributary.sources.schema import CANONICAL, CERTIFICATION, EDUCATION, EXPERIENCE, PROJECT, SKILL

SCALARS = ("full_name", "first_name", "last_name", "summary", "headline", "years_of_experience")
LISTS = ("emails", "phones", "skills", "experience", "education", "projects", "certifications", "social_links")


def one_per_source(canonical: DataFrame) -> DataFrame:
    """One record per entity and source; of several one that their contents alone determine, by hash, so that reruns agree however rows are ordered. Partial aggregation keeps a key that many rows share from meeting in one task as rows."""
    fields = [n for n in CANONICAL if n not in ("entity_id", "source")]
    held = F.struct(*fields)
    return canonical.groupBy("entity_id", "source").agg(F.max_by(held, F.xxhash64(F.to_json(held))).alias("r")).select("entity_id", "source", "r.*")


def gathered(canonical: DataFrame) -> DataFrame:
    """(entity_id, records): each entity's records in order of priority."""
    fields = [n for n in CANONICAL if n not in ("entity_id", "source")]
    ranked = one_per_source(canonical).select("entity_id", F.struct(dims.priority(F.col("source")).alias("priority"), "source", *fields).alias("r"))
    by_priority = F.array_sort(F.collect_list("r"), lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0))
    return ranked.groupBy("entity_id").agg(by_priority.alias("records"))


def order(r: Column) -> Column:
    return F.struct(r["priority"], r["source"])


def with_value(records: Column, field: str) -> Column:
    return F.filter(records, lambda r: r[field].isNotNull())


def first_value(records: Column, field: str) -> Column:
    """The value of the first source that has one."""
    return F.get(with_value(records, field), F.lit(0))[field]


def compared(v: Column) -> Column:
    """Values are the same if they are so in lower case without surrounding white space."""
    return F.lower(F.trim(v.cast("string")))


def conflicting(values: Column) -> Column:
    return F.size(F.array_distinct(F.transform(values, compared))) > 1


def merged_location(records: Column) -> Column:
    """Every part from the first source that has it."""
    return F.reduce(F.transform(with_value(records, "location"), lambda r: r["location"]), F.lit(None).cast(places.PLACE), places.filled)


def all_of(records: Column, field: str) -> Column:
    return F.flatten(F.transform(records, lambda r: r[field]))


def merged_skills(records: Column) -> Column:
    """One of each name: the first, or the first with a known level; aliases of all, sorted."""
    every = all_of(records, "skills")

    def whole(s: Column) -> Column:
        own = F.filter(every, lambda x: x["canonical_name"] == s["canonical_name"])
        best = F.coalesce(F.get(F.filter(own, lambda x: x["level"] != "unknown"), F.lit(0)), s)
        aliases = F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda x: x["aliases"]))))
        return F.struct(s["canonical_name"].alias("canonical_name"), aliases.alias("aliases"), best["level"].alias("level"), best["years_of_experience"].alias("years_of_experience"), best["category"].alias("category")).cast(SKILL)

    return F.transform(distinct_by(every, lambda x: x["canonical_name"]), whole)


def enriched_job(a: Column, b: Column) -> Column:
    """The first with its gaps filled; a job that goes on can so come to have an end."""
    return F.struct(
        a["company"].alias("company"),
        a["title"].alias("title"),
        F.coalesce(a["location"], b["location"]).alias("location"),
        F.coalesce(a["start_date"], b["start_date"]).alias("start_date"),
        F.coalesce(a["end_date"], b["end_date"]).alias("end_date"),
        a["is_current"].alias("is_current"),
        text_or(a["description"], b["description"]).alias("description"),
        list_or(a["responsibilities"], b["responsibilities"]).alias("responsibilities"),
        F.array_sort(F.array_union(a["technologies"], b["technologies"])).alias("technologies"),
        list_or(a["achievements"], b["achievements"]).alias("achievements"),
    ).cast(EXPERIENCE)


def enriched_school(a: Column, b: Column) -> Column:
    return F.struct(
        a["institution"].alias("institution"),
        F.when(a["degree"] != "unknown", a["degree"]).otherwise(b["degree"]).alias("degree"),
        text_or(a["field_of_study"], b["field_of_study"]).alias("field_of_study"),
        F.coalesce(a["start_date"], b["start_date"]).alias("start_date"),
        F.coalesce(a["end_date"], b["end_date"]).alias("end_date"),
        number_or(a["gpa"], b["gpa"]).alias("gpa"),
        list_or(a["honors"], b["honors"]).alias("honors"),
    ).cast(EDUCATION)


def enriched_project(a: Column, b: Column) -> Column:
    return F.struct(
        a["name"].alias("name"),
        text_or(a["description"], b["description"]).alias("description"),
        text_or(a["url"], b["url"]).alias("url"),
        text_or(a["repository_url"], b["repository_url"]).alias("repository_url"),
        F.array_sort(F.array_union(a["technologies"], b["technologies"])).alias("technologies"),
        a["start_date"].alias("start_date"),
        a["end_date"].alias("end_date"),
        a["is_open_source"].alias("is_open_source"),
        number_or(a["stars"], b["stars"]).alias("stars"),
        number_or(a["forks"], b["forks"]).alias("forks"),
    ).cast(PROJECT)


def kept_first(a: Column, b: Column) -> Column:
    return a


#: List, the keys that must be alike and from which similarity on, and how a later entry enriches the first.
FUZZY: dict[str, tuple[tuple[str, ...], list[float], Callable[[Column, Column], Column], str]] = {
    "experience": (("company", "title"), [dims.COMPANY, dims.TITLE], enriched_job, EXPERIENCE),
    "education": (("institution",), [dims.INSTITUTION], enriched_school, EDUCATION),
    "projects": (("name",), [dims.PROJECT], enriched_project, PROJECT),
    "certifications": (("name",), [dims.CERTIFICATION], kept_first, CERTIFICATION),
}


def lowered(entries: Column, key: str) -> Column:
    return F.transform(entries, lambda x: F.lower(x[key]))


def clustered(entries: Column, leader: Column, enrich: Callable[[Column, Column], Column], kind: str) -> Column:
    """One entry per leader: it, enriched by the entries that it leads, in order."""
    at = F.sequence(F.lit(0), F.size(entries) - 1)
    anchors = F.filter(at, lambda i: F.get(leader, i) == i)

    def whole(i: Column) -> Column:
        led = F.filter(at, lambda j: (F.get(leader, j) == i) & (j != i))
        return F.reduce(led, F.get(entries, i).cast(kind), lambda a, j: enrich(a, F.get(entries, j)))

    return F.when(F.size(entries) > 0, F.transform(anchors, whole)).otherwise(F.array().cast(f"array<{kind}>"))


def merge_records(canonical: DataFrame, cutoffs: dict[str, list[float]] | None = None) -> DataFrame:
    """One merged record per entity, its sources in order, and the records it was made of."""
    records = F.col("records")
    df = gathered(canonical)
    df = df.withColumns({f"_{f}": all_of(records, f) for f in FUZZY})
    # Entries are alike by sorted tokens, whatever their case; lists are short.
    df = df.withColumns({f"_{f}_at": leader_positions([lowered(F.col(f"_{f}"), k) for k in keys], (cutoffs or {}).get(f, cuts)) for f, (keys, cuts, _, _) in FUZZY.items()})
    made = {f: first_value(records, f) for f in SCALARS}
    made |= {f: F.array_distinct(all_of(records, f)) for f in ("emails", "phones")}
    made |= {"location": merged_location(records), "skills": merged_skills(records)}
    made |= {f: clustered(F.col(f"_{f}"), F.col(f"_{f}_at"), enrich, kind) for f, (_, _, enrich, kind) in FUZZY.items()}
    made["social_links"] = distinct_by(all_of(records, "social_links"), lambda x: x["url"])
    made["languages"] = distinct_by(all_of(records, "languages"), lambda x: F.lower(x["name"]))
    fields = [made[n].cast(k).alias(n) for n, k in CANONICAL.items() if n in made]
    return df.select("entity_id", *fields, F.transform(records, lambda r: r["source"]).alias("sources"), "records")
