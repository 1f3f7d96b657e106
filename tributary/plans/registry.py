"""Registered queries over the driver's tables, each with its SQL beside it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import arrays, contact, dates, dims, places, similarity, skills, text
from tributary.operators import confidence, lookups, mapping, merge, project, validate
from tributary.plans.engine import fuse
from tributary.plans.inputs import AS_OF, PEOPLE, as_canonical, people, table
from tributary.sources import delimited, documents, profiles, prose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its function's name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(c) -> object:
    return F.array_join(c, "|", "")


# --- Merge -------------------------------------------------------------------------------------------------------


@register(f"WITH {PEOPLE} SELECT entity_id, arg_min(full_name, priority) FILTER (full_name IS NOT NULL) AS full_name, arg_min(years, priority) FILTER (years IS NOT NULL) AS years, count(*) AS n_sources FROM people GROUP BY entity_id")
def fuse_scalar_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_records(people(spark, sf_dir)).select("entity_id", "full_name", F.col("years_of_experience").alias("years"), F.size("sources").cast("long").alias("n_sources"))


@register(
    f"""WITH {PEOPLE} SELECT entity_id, count(DISTINCT lower(trim(full_name))) > 1 AS name_conflict, count(full_name) AS n_candidates,
'Selected value from highest-priority source ''' || arg_min(source, priority) || ''' ' || CASE WHEN count(DISTINCT lower(trim(full_name))) > 1 THEN '(conflict: ' || count(full_name) || ' sources disagreed)' ELSE '(no conflict)' END AS reason
FROM people GROUP BY entity_id"""
)
def fuse_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get(F.filter("provenance", lambda x: x["field_name"] == "full_name"), F.lit(0))
    merged = confidence.with_provenance(merge.merge_records(people(spark, sf_dir)))
    return merged.select("entity_id", p["conflict_resolved"].alias("name_conflict"), F.size(p["candidates"]).cast("long").alias("n_candidates"), p["resolution_reason"].alias("reason"))


@register(
    f"""WITH {PEOPLE}, mails AS (SELECT entity_id, priority, unnest(mails) AS mail, unnest(range(len(mails))) AS pos FROM people),
firsts AS (SELECT entity_id, mail, min(priority * 100 + pos) AS ord FROM mails GROUP BY ALL)
SELECT p.entity_id, coalesce(m.emails, '') AS emails FROM (SELECT DISTINCT entity_id FROM people) p LEFT JOIN (SELECT entity_id, string_agg(mail, '|' ORDER BY ord) AS emails FROM firsts GROUP BY entity_id) m USING (entity_id)"""
)
def fuse_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_records(people(spark, sf_dir)).select("entity_id", joined(F.col("emails")).alias("emails"))


@register(
    f"""WITH {PEOPLE}, mails AS (SELECT entity_id, source, priority, unnest(mails) AS mail, unnest(range(len(mails))) AS pos FROM people)
SELECT entity_id, mail, source, pos::BIGINT AS pos FROM mails QUALIFY row_number() OVER (PARTITION BY entity_id, mail ORDER BY priority, pos) = 1"""
)
def fuse_keyed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = people(spark, sf_dir).select("entity_id", "source", dims.priority(F.col("source")).alias("priority"), F.posexplode("emails").alias("pos", "mail"))
    return lookups.first_of_key(mails, ["entity_id", "mail"], [F.col("priority"), F.col("pos")]).select("entity_id", "mail", "source", F.col("pos").cast("long").alias("pos"))


@register(
    """WITH own AS (
  SELECT user_id::VARCHAR AS entity_id, event_type AS name, CASE WHEN value > 50 THEN 0 ELSE 3 END AS priority, CASE WHEN value > 50 THEN 'unknown' ELSE 'expert' END AS level, event_type || '-' || CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS alias FROM events
) SELECT entity_id, name, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases, CASE WHEN bool_or(level = 'expert') THEN 'expert' ELSE 'unknown' END AS level FROM own GROUP BY entity_id, name"""
)
def fuse_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.coalesce(F.col("value") > 50, F.lit(False))
    own = F.struct(
        F.col("event_type").alias("canonical_name"), F.array(F.concat_ws("-", "event_type", F.when(high, "a").otherwise("b"))).alias("aliases"), F.when(high, "unknown").otherwise("expert").alias("level"),
        F.lit(None).cast("double").alias("years_of_experience"), F.lit(None).cast("string").alias("category"),
    )
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity"), F.when(high, "ats").otherwise("github").alias("from"), own.alias("skill"))
    held = rows.groupBy("entity", "from").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    parts = [as_canonical(held.where(F.col("from") == s), s, F.col("entity"), skills=F.col("skills")) for s in ("ats", "github")]
    merged = merge.merge_records(parts[0].unionByName(parts[1])).select("entity_id", F.explode("skills").alias("s"))
    return merged.select("entity_id", F.col("s.canonical_name").alias("name"), joined(F.col("s.aliases")).alias("aliases"), F.col("s.level").alias("level"))


@register(
    f"""WITH {PEOPLE} SELECT entity_id, arg_min(city, priority) FILTER (city <> '') AS city, arg_min(state, priority) FILTER (state <> '') AS state, arg_min(country, priority) FILTER (country <> '') AS country,
bool_or(placed) AS placed FROM people GROUP BY entity_id"""
)
def fuse_location_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("location")
    part = lambda k: text.null_if_empty(p[k]).alias(k)
    return merge.merge_records(people(spark, sf_dir)).select("entity_id", part("city"), part("state"), part("country"), p.isNotNull().alias("placed"))


_NAMES = f"""WITH {PEOPLE}, won AS (SELECT entity_id, arg_min(full_name, priority) AS winner, arg_min(weight, priority) AS base FROM people GROUP BY entity_id),
counted AS (SELECT entity_id, any_value(base) AS base, greatest(0, count(*) FILTER (lower(trim(full_name)) = lower(trim(winner))) - 1) AS agreed, count(*) FILTER (lower(trim(full_name)) <> lower(trim(winner))) AS disagreed
  FROM people JOIN won USING (entity_id) GROUP BY entity_id),
names AS (SELECT entity_id, agreed, disagreed, round(greatest(0.0, least(1.0, base + 0.05::DOUBLE * agreed - 0.1::DOUBLE * disagreed)), 4) AS score FROM counted)"""


@register(f"{_NAMES} SELECT entity_id, score, agreed, disagreed FROM names")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confidence.with_confidence(confidence.with_provenance(merge.merge_records(people(spark, sf_dir))))
    f = F.col("confidence.fields")["full_name"]
    return c.select("entity_id", f["score"].alias("score"), f["sources_agreed"].cast("long").alias("agreed"), f["sources_disagreed"].cast("long").alias("disagreed"))


_SCORES = f"""{_NAMES}, years AS (SELECT entity_id, arg_min(weight, priority) + 0.05::DOUBLE * (count(*) - 1) AS score FROM people WHERE years IS NOT NULL GROUP BY entity_id),
places AS (SELECT entity_id, CASE WHEN count(*) = 2 THEN round(0.95::DOUBLE - 0.2::DOUBLE, 4) ELSE min(weight) END AS score FROM people WHERE placed GROUP BY entity_id),
notes AS (SELECT entity_id FROM people WHERE source = 'notes'),
scored AS (SELECT entity_id, 'full_name' AS field, score, 1.0::DOUBLE AS w FROM names UNION ALL SELECT entity_id, 'years_of_experience', round(least(1.0, score), 4), 0.7::DOUBLE FROM years UNION ALL SELECT entity_id, 'location', score, 0.7::DOUBLE FROM places
  UNION ALL SELECT entity_id, 'summary', 0.7::DOUBLE, 0.6::DOUBLE FROM notes
  UNION ALL SELECT entity_id, f.field, 0.5::DOUBLE, f.w::DOUBLE FROM names, (VALUES ('emails', 1.0), ('phones', 0.8), ('skills', 0.9), ('experience', 0.9), ('education', 0.8), ('projects', 0.5), ('certifications', 0.5), ('social_links', 0.4)) f(field, w))"""


@register(f"{_SCORES} SELECT entity_id, round(sum(score * w) / sum(w), 4) AS overall, count(*) AS n_fields FROM scored GROUP BY entity_id")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confidence.with_confidence(confidence.with_provenance(merge.merge_records(people(spark, sf_dir))))
    return c.select("entity_id", F.col("confidence.overall_score").alias("overall"), F.size("confidence.fields").cast("long").alias("n_fields"))


@register(f"{_SCORES} SELECT entity_id, coalesce(string_agg(field, '|' ORDER BY field) FILTER (score >= 0.9), '') AS high, coalesce(string_agg(field, '|' ORDER BY field) FILTER (score < 0.7), '') AS low FROM scored GROUP BY entity_id")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confidence.with_confidence(confidence.with_provenance(merge.merge_records(people(spark, sf_dir))))
    return c.select("entity_id", joined(F.col("confidence.high_confidence_fields")).alias("high"), joined(F.col("confidence.low_confidence_fields")).alias("low"))


@register(
    f"""{_NAMES}, lists AS (SELECT entity_id, unnest(['emails', 'phones', 'skills', 'experience', 'education', 'projects', 'certifications', 'social_links']) AS field FROM names)
SELECT entity_id, field, 'unknown' AS source, 1.0::DOUBLE AS confidence, 0::BIGINT AS n_candidates FROM lists
UNION ALL SELECT entity_id, 'full_name', arg_min(source, priority), arg_min(weight, priority), count(*) FROM people GROUP BY entity_id
UNION ALL SELECT entity_id, 'summary', 'notes', 0.7, 1 FROM people WHERE source = 'notes'
UNION ALL SELECT entity_id, 'years_of_experience', arg_min(source, priority), arg_min(weight, priority), count(*) FROM people WHERE years IS NOT NULL GROUP BY entity_id
UNION ALL SELECT entity_id, 'location', arg_min(source, priority), arg_min(weight, priority), count(*) FROM people WHERE placed GROUP BY entity_id"""
)
def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = confidence.with_provenance(merge.merge_records(people(spark, sf_dir))).select("entity_id", F.explode("provenance").alias("p"))
    return rows.select("entity_id", F.col("p.field_name").alias("field"), F.col("p.selected.source").alias("source"), F.col("p.selected.confidence").alias("confidence"), F.size("p.candidates").cast("long").alias("n_candidates"))


# --- Likeness ----------------------------------------------------------------------------------------------------

_SORTED = "array_to_string(list_sort(string_split(lower({0}), ' ')), ' ')"
_LCS = """list_reduce(list_prepend(list_transform(range(length({b}) + 1), lambda z: 0), list_transform(range(1, length({a}) + 1), lambda i: [i])),
  lambda prev, i: list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j])),
    lambda own, j: list_append(own, CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], own[j[1]]) END)))[length({b}) + 1]"""
_RATIO = f"CASE WHEN a = b THEN 100.0 ELSE 200.0 * {_LCS.format(a='a', b='b')} / (length(a) + length(b)) END"


@register(
    f"""WITH names AS (SELECT DISTINCT p_name AS name, {_SORTED.format('p_name')} AS s FROM part), pairs AS (SELECT x.name AS left_name, y.name AS right_name, x.s AS a, y.s AS b FROM names x JOIN names y ON x.name < y.name)
SELECT left_name, right_name, round({_RATIO}, 6)::DOUBLE AS ratio FROM pairs WHERE {_RATIO} >= 70"""
)
def fuzzy_pairs_partname(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return lookups.like_pairs(names, 70).withColumn("ratio", F.round("ratio", 6))


@register(
    f"""WITH dim AS (SELECT p_name AS alias, row_number() OVER (ORDER BY p_name) - 1 AS pos FROM (SELECT DISTINCT p_name FROM part)),
keys AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE lower(replace(p_name, 'e', '') || 's') END AS key FROM part),
pairs AS (SELECT key, alias, pos, {_SORTED.format('key')} AS a, {_SORTED.format('alias')} AS b FROM keys, dim WHERE key NOT IN (SELECT alias FROM dim)),
rated AS (SELECT key, alias, pos, {_RATIO} AS score FROM pairs)
SELECT key, alias AS name, round(score, 6)::DOUBLE AS score FROM rated WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) = 1"""
)
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    names = sorted(r[0] for r in parts.select("p_name").distinct().collect())
    keys = parts.select(F.when(F.expr("p_partkey % 3 = 0"), F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit("e"), F.lit("")), F.lit("s"))).alias("key"))
    return lookups.likest(keys, lookups.dictionary(spark, {n: n for n in names})).withColumn("score", F.round("score", 6))


# A leader is the earliest entry that is its own leader and like in every key; folded entry by entry.
_FOLD = """fold(g, pos, anchors, leader) AS (
  SELECT g, 0, [0], 0 FROM entries WHERE pos = 0
  UNION ALL
  SELECT g, pos, CASE WHEN l IS NULL THEN list_append(anchors, pos) ELSE anchors END, coalesce(l, pos)
  FROM (SELECT f.g, e.pos, f.anchors, list_min(list_filter(e.likes, lambda x: list_contains(f.anchors, x))) AS l FROM fold f JOIN entries e ON e.g = f.g AND e.pos = f.pos + 1)
)"""


@register(
    f"""WITH RECURSIVE names AS (SELECT p_brand AS g, p_name, {_SORTED.format('p_name')} AS s, (row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1)::INT AS pos FROM (SELECT DISTINCT p_brand, p_name FROM part)),
texts AS (SELECT DISTINCT s FROM names), rated AS (SELECT a, b, {_RATIO} AS r FROM (SELECT x.s AS a, y.s AS b FROM texts x, texts y WHERE x.s <> y.s)),
entries AS (SELECT n.g, n.pos, n.p_name, coalesce(list(m.pos) FILTER (m.pos IS NOT NULL AND coalesce(r, 100) >= {dims.PROJECT}), []) AS likes
  FROM names n LEFT JOIN names m ON m.g = n.g AND m.pos < n.pos LEFT JOIN rated ON a = m.s AND b = n.s GROUP BY n.g, n.pos, n.p_name),
{_FOLD}
SELECT f.g AS p_brand, f.pos::BIGINT AS pos, p_name AS name, leader::BIGINT AS leader FROM fold f JOIN entries e ON e.g = f.g AND e.pos = f.pos"""
)
def fuzzy_leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    led = brands.withColumn("leader", similarity.leader_positions([F.transform("names", F.lower)], [dims.PROJECT]))
    return led.select("p_brand", F.posexplode("names").alias("pos", "name"), "leader").select("p_brand", F.col("pos").cast("long").alias("pos"), "name", F.get("leader", F.col("pos")).cast("long").alias("leader"))


# Entries of three sources of one entity (parts in threes): alike, alike but for case, order or a word, and unlike; each source leaves other gaps.
_FIRM = "CASE (p_partkey div 3) % 4 WHEN 0 THEN 'acme industrial works' WHEN 1 THEN 'globex corporation' WHEN 2 THEN 'initech data systems' ELSE 'umbrella health group' END"
_POST = "CASE (p_partkey div 3) % 3 WHEN 0 THEN 'data engineer' WHEN 1 THEN 'software architect' ELSE 'site reliability engineer' END"
_BY_SOURCE = "CASE p_partkey % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
_DAY = "date_add(DATE '2015-01-01', p_size)"


def _by(ats: str, csv: str, notes: str) -> str:
    return _BY_SOURCE.format(ats, csv, notes)


#: kind: (entries of one record, each a dict of SQL expressions that Spark and DuckDB both read).
_ENTRIES = {
    "experience": [
        {"name": _by(_FIRM, f"upper({_FIRM})", f"concat({_FIRM}, ' inc')"), "title": _by(_POST, f"concat('senior ', {_POST})", "'manager'"), "start": _by("NULL", _DAY, "NULL"), "finish": _by("NULL", "NULL", _DAY),
         "descr": _by("''", "concat('d ', p_brand)", "NULL"), "items": _by("[]", "[p_brand]", "[p_type]"), "tech": _by("['sql', p_brand]", "['python', 'sql']", "[]")},
        {"name": "p_name", "title": "concat('handler ', p_size % 4)", "start": _DAY, "finish": "NULL", "descr": "p_type", "items": "[]", "tech": "['b', 'a']"},
    ],
    "education": [
        {"name": _by("concat('university of ', substr(p_brand, 1, 5))", "concat('Of ', substr(p_brand, 1, 5), ' University')", "concat('institute ', p_name)"), "start": _by("NULL", _DAY, "NULL"), "descr": _by("''", "'maths'", "p_type"),
         "amount": _by("0.0", "p_size / 20.0", "NULL"), "items": _by("[]", "[p_brand]", "[]"), "degree": _by("'unknown'", "'master'", "'phd'")},
    ],
    "projects": [
        {"name": _by("concat('project ', (p_partkey div 3) % 50)", "concat('PROJECT ', (p_partkey div 3) % 50)", "concat('project ', p_name)"), "title": _by("''", "p_brand", "p_type"), "descr": _by("NULL", "p_type", "'x'"), "amount": _by("0", "p_size", "3"), "tech": _by("['z', 'a']", "['m']", "[]")},
    ],
    "certifications": [
        {"name": _by(f"concat('certified ', {_FIRM})", f"concat('Certified ', {_FIRM}, 's')", "p_type"), "title": "p_brand"},
    ],
}
_KINDS = {"name": "VARCHAR", "title": "VARCHAR", "start": "DATE", "finish": "DATE", "descr": "VARCHAR", "amount": "DOUBLE", "items": "VARCHAR[]", "tech": "VARCHAR[]", "degree": "VARCHAR"}


def _duck(x: str) -> str:
    return x.replace(" div ", " // ").replace(_DAY, "(DATE '2015-01-01' + p_size::INT)")


def _spark(x: str) -> str:
    return x.replace("[]", "array()").replace("[", "array(").replace("]", ")").replace("array()", "cast(array() as array<string>)")


_ENTRY_SQL = " UNION ALL ".join(
    f"SELECT p_partkey // 3 AS e, '{kind}' AS kind, (p_partkey % 3) * 10 + {i} AS ord, " + ", ".join(f"({_duck(x.get(c, 'NULL'))})::{t} AS {'begun' if c == 'start' else c}" for c, t in _KINDS.items()) + " FROM part" for kind, own in _ENTRIES.items() for i, x in enumerate(own)
)


@register(
    f"""WITH RECURSIVE raw AS ({_ENTRY_SQL}),
listed AS (SELECT *, e || kind AS g, (row_number() OVER (PARTITION BY e, kind ORDER BY ord) - 1)::INT AS pos, {_SORTED.format('name')} AS s1, CASE WHEN kind = 'experience' THEN {_SORTED.format('title')} ELSE '' END AS s2 FROM raw),
couples AS (SELECT y.g, x.pos AS i, y.pos AS j, x.s1 AS a1, y.s1 AS b1, x.s2 AS a2, y.s2 AS b2, y.kind FROM listed x JOIN listed y ON x.g = y.g AND x.pos < y.pos),
rated AS (SELECT a, b, {_RATIO} AS r FROM (SELECT a1 AS a, b1 AS b FROM couples UNION SELECT a2, b2 FROM couples)),
alike AS (SELECT c.g, i, j FROM couples c JOIN rated r1 ON r1.a = a1 AND r1.b = b1 JOIN rated r2 ON r2.a = a2 AND r2.b = b2
  WHERE r1.r >= CASE kind WHEN 'experience' THEN {dims.COMPANY} WHEN 'education' THEN {dims.INSTITUTION} WHEN 'projects' THEN {dims.PROJECT} ELSE {dims.CERTIFICATION} END AND r2.r >= {dims.TITLE}),
entries AS (SELECT l.g, l.pos, coalesce(list(i) FILTER (i IS NOT NULL), []) AS likes FROM listed l LEFT JOIN alike k ON k.g = l.g AND k.j = l.pos GROUP BY l.g, l.pos),
{_FOLD},
led AS (SELECT l.*, leader FROM listed l JOIN fold f ON f.g = l.g AND f.pos = l.pos),
whole AS (SELECT e::VARCHAR AS entity_id, kind, leader, arg_min(name, pos) AS name, CASE WHEN kind = 'projects' THEN coalesce(arg_min(title, pos) FILTER (title <> ''), '') ELSE arg_min(title, pos) END AS title, arg_min(begun, pos) FILTER (begun IS NOT NULL) AS begun,
  arg_min(finish, pos) FILTER (finish IS NOT NULL) AS finish, arg_min(descr, pos) FILTER (descr <> '') AS descr, arg_min(amount, pos) FILTER (amount <> 0) AS amount,
  arg_min(items, pos) FILTER (len(items) > 0) AS items, CASE WHEN count(*) = 1 THEN any_value(tech) ELSE list_sort(list_distinct(flatten(list(coalesce(tech, []))))) END AS tech, coalesce(arg_min(degree, pos) FILTER (degree <> 'unknown'), any_value(degree)) AS degree
  FROM led GROUP BY e, kind, leader)
SELECT entity_id, kind, (row_number() OVER (PARTITION BY entity_id, kind ORDER BY leader) - 1)::BIGINT AS idx, name, title, begun::VARCHAR AS begun, finish::VARCHAR AS finish, coalesce(descr, '') AS descr,
  coalesce(amount, 0) AS amount, coalesce(array_to_string(items, '|'), '') AS items, coalesce(array_to_string(tech, '|'), '') AS tech, degree FROM whole"""
)
def fuse_fuzzy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, schools, projects and certificates of several sources: like ones become one, the first, whose gaps the others fill."""
    made = {
        "experience": lambda x: F.struct(x["name"].alias("company"), x["title"].alias("title"), F.lit(None).cast(places.PLACE).alias("location"), x["start"].alias("start_date"), x["finish"].alias("end_date"), F.lit(False).alias("is_current"), x["descr"].alias("description"), x["items"].alias("responsibilities"), x["tech"].alias("technologies"), arrays.no_strings().alias("achievements")),
        "education": lambda x: F.struct(x["name"].alias("institution"), x["degree"].alias("degree"), x["descr"].alias("field_of_study"), x["start"].alias("start_date"), x["finish"].alias("end_date"), x["amount"].alias("gpa"), x["items"].alias("honors")),
        "projects": lambda x: F.struct(x["name"].alias("name"), x["descr"].alias("description"), x["title"].alias("url"), F.lit(None).cast("string").alias("repository_url"), x["tech"].alias("technologies"), x["start"].alias("start_date"), x["finish"].alias("end_date"), F.lit(True).alias("is_open_source"), x["amount"].cast("int").alias("stars"), F.lit(0).alias("forks")),
        "certifications": lambda x: F.struct(x["name"].alias("name"), x["title"].alias("issuing_organization"), *(F.lit(None).alias(n) for n in ("issue_date", "expiry_date", "credential_id", "credential_url"))),
    }
    types = {"VARCHAR": "string", "VARCHAR[]": "array<string>"}
    each = lambda own: {c: F.expr(_spark(own.get(c, "NULL"))).cast(types.get(t, t)) for c, t in _KINDS.items()}
    lists = {kind: F.array(*(made[kind](each(x)) for x in own)) for kind, own in _ENTRIES.items()}
    source = F.expr(_by("'ats'", "'csv'", "'notes'"))
    records = as_canonical(table(spark, sf_dir, "part"), source, F.expr("p_partkey div 3").cast("string"), **lists)
    merged = merge.merge_records(records)
    none = lambda t: F.lit(None).cast(t)
    shown = {
        "experience": lambda x: (x["company"], x["title"], x["start_date"], x["end_date"], x["description"], none("double"), x["responsibilities"], x["technologies"], none("string")),
        "education": lambda x: (x["institution"], none("string"), x["start_date"], x["end_date"], x["field_of_study"], x["gpa"], x["honors"], none("array<string>"), x["degree"]),
        "projects": lambda x: (x["name"], x["url"], x["start_date"], x["end_date"], x["description"], x["stars"], none("array<string>"), x["technologies"], none("string")),
        "certifications": lambda x: (x["name"], x["issuing_organization"], none("date"), none("date"), none("string"), none("double"), none("array<string>"), none("array<string>"), none("string")),
    }

    def row(kind: str, i: Column, x: Column) -> Column:
        name, title, start, finish, descr, amount, items, tech, degree = shown[kind](x)
        day = lambda d: d.cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), i.cast("long").alias("idx"), name.alias("name"), title.alias("title"), day(start).alias("begun"), day(finish).alias("finish"), F.coalesce(descr, F.lit("")).alias("descr"),
            F.coalesce(amount.cast("double"), F.lit(0.0)).alias("amount"), F.coalesce(joined(items), F.lit("")).alias("items"), F.coalesce(joined(tech), F.lit("")).alias("tech"), degree.alias("degree"),
        )

    rows = lambda kind: F.transform(F.col(kind), lambda x, i: row(kind, i, x))
    every = F.concat(*map(rows, _ENTRIES))
    return merged.select("entity_id", F.explode(every).alias("x")).select("entity_id", "x.*")


# --- Text --------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _clean(c: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(regexp_replace({c}, '{_SPACE}', ' ', 'g'), '[^\\x{{0020}}-\\x{{007E}}\\x{{00A0}}-\\x{{FFFF}}]', '', 'g'), ' {{2,}}', ' ', 'g')), '')"


@register(f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


def _title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


@register(f"SELECT p_partkey, {_title(_clean('replace(upper(p_name), chr(32), chr(39)) || chr(45) || p_brand'))} AS name FROM part")
def title_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace(F.upper("p_name"), F.lit(" "), F.lit("'")), F.lit("-"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.title_name(name).alias("name"))


@register(
    """WITH named AS (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' inc.' WHEN 1 THEN '  LTD' WHEN 2 THEN ' gmbh & co' ELSE ' group' END AS name FROM supplier),
words AS (SELECT s_suppkey, list_filter(string_split(name, ' '), lambda w: w <> '') AS ws FROM named)
SELECT s_suppkey, array_to_string(list_transform(ws, lambda w: CASE WHEN lower(rtrim(w, '.')) IN ('llc','inc','ltd','corp','co','ag','gmbh','sa','plc') THEN upper(rtrim(w, '.')) || CASE WHEN ends_with(w, '.') THEN '.' ELSE '' END ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS company FROM words"""
)
def company_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("s_suppkey % 4")
    name = F.concat("s_name", F.when(kind == 0, " inc.").when(kind == 1, "  LTD").when(kind == 2, " gmbh & co").otherwise(" group"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.company_case(name).alias("company"))


@register(
    """WITH named AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN p_name || ' ' || p_brand ELSE p_brand || ', ' || p_name END AS name, p_partkey % 4 = 3 AS comma FROM part),
ws AS (SELECT p_partkey, comma, list_filter(string_split(CASE WHEN comma THEN trim(substr(name, strpos(name, ',') + 1)) ELSE name END, ' '), lambda w: w <> '') AS w, split_part(name, ',', 1) AS head FROM named)
SELECT p_partkey, w[1] AS first, CASE WHEN comma THEN CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') END AS middle, CASE WHEN comma THEN trim(head) WHEN len(w) > 1 THEN w[len(w)] END AS last FROM ws"""
)
def split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("p_partkey % 4")
    name = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 2, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat_ws(", ", "p_brand", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.split_name(name).alias("n")).select("p_partkey", "n.first", "n.middle", "n.last")


@register("SELECT doc_id, CASE WHEN length(text) > 100 THEN rtrim(substr(text, 1, 100), ' ') || '…' ELSE text END AS short FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 100).alias("short"))


@register(
    """WITH items AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE ' ' || o_orderpriority END AS item FROM orders),
firsts AS (SELECT o_custkey, lower(trim(item)) AS key, arg_min(trim(item), o_orderkey) AS item, min(o_orderkey) AS ord FROM items GROUP BY ALL)
SELECT o_custkey, string_agg(item, '|' ORDER BY ord) AS items FROM firsts GROUP BY o_custkey"""
)
def distinct_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.expr("o_orderkey % 2 = 0"), F.lower("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("items"))
    return held.select("o_custkey", joined(arrays.distinct_ignoring_case(F.transform("items", lambda x: x["item"]))).alias("items"))


# --- Contact data ------------------------------------------------------------------------------------------------


def _found(pattern: str) -> str:
    return f"""WITH hits AS (SELECT doc_id, h, i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hs FROM documents), unnest(hs) WITH ORDINALITY AS u(h, i)),
firsts AS (SELECT doc_id, h, min(i) AS ord FROM hits GROUP BY ALL) SELECT doc_id, string_agg(h, '|' ORDER BY ord) AS found FROM firsts GROUP BY doc_id"""


@register(_found(contact.EMAIL))
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", contact.found(F.col("text"), contact.EMAIL).alias("found"))
    return rows.where(F.size("found") > 0).withColumn("found", joined(F.col("found")))


@register(_found(contact.PHONE))
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", contact.found(F.col("text"), contact.PHONE).alias("found"))
    return rows.where(F.size("found") > 0).withColumn("found", joined(F.col("found")))


_MAIL = """CASE c_custkey % 6 WHEN 0 THEN ' ' || upper(replace(c_name, '#', '.')) || '+tag@Example.COM ' WHEN 1 THEN replace(c_name, '#', '.') || '.x@gmail.com' WHEN 2 THEN c_name || '@mail.example.org' WHEN 3 THEN '.' || c_custkey || '@x.org'
 WHEN 4 THEN c_custkey || '@no-top' ELSE 'a..b@x.org' END"""


@register(
    f"""WITH mails AS (SELECT c_custkey, lower(trim({_MAIL})) AS m FROM customer), ok AS (SELECT *, regexp_matches(m, '{contact.VALID_EMAIL.replace("'", "''")}') AS valid FROM mails)
SELECT c_custkey, valid, CASE WHEN valid THEN CASE WHEN split_part(m, '@', 2) IN ('gmail.com', 'googlemail.com') THEN replace(split_part(split_part(m, '@', 1), '+', 1), '.', '') ELSE split_part(split_part(m, '@', 1), '+', 1) END || '@' || split_part(m, '@', 2) END AS email FROM ok"""
)
def normalize_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.expr(_MAIL)
    return table(spark, sf_dir, "customer").select("c_custkey", contact.is_email(mail).alias("valid"), contact.normal_email(mail).alias("email"))


_PHONE = """CASE c_custkey % 7 WHEN 0 THEN '(415) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN 'Tel: 1-212-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 2 THEN '+1 (646) 555 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
 WHEN 3 THEN '+44 20 7946 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 4 THEN '123-456-7890' WHEN 5 THEN 'phone: ' || c_custkey ELSE 'call me' END"""


@register(
    f"""WITH p AS (SELECT c_custkey, {_PHONE} AS raw FROM customer), d AS (SELECT c_custkey, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM p)
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '+1' || digits WHEN 1 THEN '+' || digits WHEN 2 THEN '+' || digits WHEN 3 THEN '+' || digits END AS phone, CASE WHEN c_custkey % 7 < 3 THEN 'US' END AS region FROM d"""
)
def normalize_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_PHONE.replace("::VARCHAR", "").replace("lpad((c_custkey % 10000), ", "lpad(string(c_custkey % 10000), "))
    return table(spark, sf_dir, "customer").select("c_custkey", contact.normal_phone(raw).alias("phone"), contact.phone_region(raw).alias("region"))


@register(
    r"""WITH u AS (SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(http|https|ftp)://') THEN trim(url) ELSE 'https://' || trim(url) END AS url FROM pages),
p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^.*@', '')) AS host, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS url FROM p"""
)
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", contact.normal_url(F.col("url")).alias("url"))


_PROFILE = "CASE page_id % 6 WHEN 0 THEN 'https://www.LinkedIn.com/in/u' || page_id WHEN 1 THEN 'https://github.com/u' || page_id || '/repo' WHEN 2 THEN 'http://x.com/u' || page_id WHEN 3 THEN 'https://stackoverflow.com/users/' || page_id WHEN 4 THEN 'https://github.com/' ELSE url END"


@register(
    f"""WITH p AS (SELECT page_id, {_PROFILE} AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '(?i)linkedin\\.com/in/') THEN 'linkedin' WHEN regexp_matches(u, '(?i)github\\.com/') THEN 'github'
WHEN regexp_matches(u, '(?i)(twitter|x)\\.com/') THEN 'twitter' WHEN regexp_matches(u, '(?i)stackoverflow\\.com/users/') THEN 'stackoverflow' ELSE 'other' END AS platform FROM p"""
)
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", contact.platform(F.expr(_PROFILE)).alias("platform"))


@register(f"WITH p AS (SELECT page_id, {_PROFILE} AS u FROM pages) SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'u' || page_id END AS login, nullif(regexp_extract(u, '^[A-Za-z]+://[^/?#]*/+([^/?#]+)', 1), '') AS first_part FROM p")
def url_path_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(_PROFILE)
    return table(spark, sf_dir, "pages").select("page_id", contact.code_host_user(u).alias("login"), contact.first_path_part(u).alias("first_part"))


# --- Dictionaries ------------------------------------------------------------------------------------------------

# The skill dictionary, and terms of the texts' languages.
_TERMS = sorted({*skills.alias_table(), "the", "of the", "in the", "de la", "und", "idiot", "por que la", "licensed under the", "mit license", "under the mit license. ", "-- "})


def _pieces(term: str) -> str:
    """A term's pieces between word boundaries, for SQL."""
    return "chr(1)".join(f"'{x}'" for x in re.findall(r"\w+|\W+", term)).replace("chr(1)", " || chr(1) || ")


@register(
    f"""WITH terms(term, pieces) AS (VALUES {", ".join(f"('{t}', {_pieces(t)})" for t in _TERMS)}),
ws AS (SELECT doc_id, chr(1) || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), chr(1)) || chr(1) AS w FROM documents)
SELECT doc_id AS id, term FROM ws, terms WHERE contains(w, chr(1) || pieces || chr(1))"""
)
def term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.terms_by_join(table(spark, sf_dir, "documents"), lookups.dictionary(spark, {t: t for t in _TERMS}))


_ALIAS = "CASE event_type WHEN 'view' THEN ' K8s' WHEN 'click' THEN 'ReactJS' WHEN 'signup' THEN 'py' WHEN 'purchase' THEN 'Scrum' ELSE 'weaving' END"


@register(f"SELECT event_id, CASE {_ALIAS} WHEN ' K8s' THEN 'Kubernetes' WHEN 'ReactJS' THEN 'React' WHEN 'py' THEN 'Python' WHEN 'Scrum' THEN 'Scrum' END AS name FROM events")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_alias(table(spark, sf_dir, "events"), F.expr(_ALIAS), lookups.dictionary(spark, skills.alias_table())).select("event_id", "name")


@register(f"SELECT event_id, CASE {_ALIAS} WHEN ' K8s' THEN 'Kubernetes' WHEN 'ReactJS' THEN 'React' WHEN 'py' THEN 'Python' WHEN 'Scrum' THEN 'Scrum' ELSE 'Weaving' END AS name FROM events")
def skill_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get(skills.normal_skills(F.array(F.expr(_ALIAS))), F.lit(0)).alias("name"))


_COUNTRY_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in dims.COUNTRIES.items())


@register(f"WITH dim(name, code) AS (VALUES {_COUNTRY_ROWS}) SELECT c_custkey, code FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN dim ON name = lower(n_name)")
def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select("c_custkey", dims.lookup(dims.COUNTRIES, F.lower("n_name")).alias("code"))


_STATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in dims.STATES.items())
_PLACE = "CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'Town, ' || n_name WHEN 2 THEN ' Town , ' || upper(substr(n_name, 1, 2)) WHEN 3 THEN 'Town, ' || substr(n_name, 1, 2) || ', ' || n_name WHEN 4 THEN 'WFH' ELSE ' ' END"


@register(
    f"""WITH dim(name, code) AS (VALUES {_COUNTRY_ROWS}), st(abbr, state) AS (VALUES {_STATE_ROWS}), raw AS (SELECT c_custkey, c_custkey % 6 AS k, n_name, trim({_PLACE}) AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE k WHEN 0 THEN n_name WHEN 4 THEN 'Remote' WHEN 5 THEN NULL ELSE 'Town' END AS city,
CASE k WHEN 1 THEN CASE WHEN code IS NULL THEN coalesce(s1.state, n_name) END WHEN 2 THEN CASE WHEN d2.c2 IS NULL THEN coalesce(s2.state, upper(substr(n_name, 1, 2))) END WHEN 3 THEN substr(n_name, 1, 2) END AS state,
CASE k WHEN 1 THEN CASE WHEN code IS NOT NULL THEN n_name WHEN s1.state IS NOT NULL THEN 'United States' END WHEN 2 THEN CASE WHEN d2.c2 IS NOT NULL THEN upper(substr(n_name, 1, 2)) WHEN s2.state IS NOT NULL THEN 'United States' END WHEN 3 THEN n_name END AS country,
CASE k WHEN 1 THEN CASE WHEN code IS NOT NULL THEN code WHEN s1.state IS NOT NULL THEN 'US' END WHEN 2 THEN CASE WHEN d2.c2 IS NOT NULL THEN d2.c2 WHEN s2.state IS NOT NULL THEN 'US' END WHEN 3 THEN code END AS code
FROM raw LEFT JOIN dim ON name = lower(n_name) LEFT JOIN st s1 ON s1.abbr = lower(n_name) LEFT JOIN st s2 ON s2.abbr = lower(substr(n_name, 1, 2)) LEFT JOIN (SELECT name AS n2, code AS c2 FROM dim) d2 ON d2.n2 = lower(substr(n_name, 1, 2))"""
)
def parse_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = customers.select("c_custkey", places.parse_place(F.expr(_PLACE)).alias("p"))
    return found.select("c_custkey", "p.city", "p.state", "p.country", F.col("p.country_code").alias("code"))


_DEGREE = "CASE p_partkey % 6 WHEN 0 THEN 'Master of Science in ' || p_name WHEN 1 THEN 'B.Sc ' || p_name WHEN 2 THEN 'PhD' WHEN 3 THEN p_type WHEN 4 THEN '' ELSE 'Diploma, MBA' END"


@register(
    f"""WITH d AS (SELECT p_partkey, lower({_DEGREE}) AS d FROM part) SELECT p_partkey, CASE WHEN d = '' THEN 'unknown' {" ".join(f"WHEN contains(d, '{k}') THEN '{v}'" for k, v in dims.DEGREES)} ELSE 'other' END AS degree FROM d"""
)
def degree_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", mapping.degree(F.expr(_DEGREE)).alias("degree"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND p_size / 10.0 BETWEEN 0 AND 4 THEN p_size / 10.0::DOUBLE END AS gpa FROM part")
def gpa_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(string(p_size / 10.0D), '/4.0') WHEN 1 THEN string(p_size / 10.0D) ELSE 'good' END")
    return table(spark, sf_dir, "part").select("p_partkey", mapping.gpa(raw).alias("gpa"))


# --- Dates -------------------------------------------------------------------------------------------------------

_FORMATS = {0: "yyyy-MM-dd", 1: "MMM yyyy", 2: "yyyy", 3: "M/d/yyyy", 4: "MMMM d, yyyy", 5: "yyyy-MM", 6: "d MMM yyyy"}


@register(
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 5 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN date_trunc('year', o_orderdate)::DATE WHEN 7 THEN date_trunc('quarter', o_orderdate)::DATE
WHEN 8 THEN DATE '2024-01-01' ELSE o_orderdate::DATE END::VARCHAR AS parsed FROM orders"""
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.expr("o_orderkey % 9 = 7"), F.format_string("Q%d %d", F.quarter("o_orderdate"), F.year("o_orderdate"))).when(F.expr("o_orderkey % 9 = 8"), "Present")
    for k, f in _FORMATS.items():
        raw = raw.when(F.expr(f"o_orderkey % 9 = {k}"), F.date_format("o_orderdate", f))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(raw, F.lit(AS_OF).cast("date"), end=True).cast("string").alias("parsed"))


@register(
    """SELECT l_orderkey, l_linenumber, date_trunc('month', l_shipdate)::DATE::VARCHAR AS start, CASE WHEN l_linenumber % 3 = 0 THEN DATE '2024-01-01' WHEN l_linenumber % 3 = 1 THEN (date_trunc('month', l_shipdate) + INTERVAL 14 MONTH)::DATE END::VARCHAR AS finish, l_linenumber % 3 = 0 AS current,
CASE WHEN l_linenumber % 3 = 0 THEN greatest(0, (2024 - year(l_shipdate)) * 12 + 1 - month(l_shipdate)) WHEN l_linenumber % 3 = 1 THEN 14 END::BIGINT AS months FROM lineitem"""
)
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, day = F.date_format("l_shipdate", "MMM yyyy"), F.lit(AS_OF).cast("date")
    later = F.date_format(F.add_months("l_shipdate", 14), "MMMM yyyy")
    raw = F.when(F.expr("l_linenumber % 3 = 0"), F.concat(start, F.lit(" – Present"))).when(F.expr("l_linenumber % 3 = 1"), F.concat(start, F.lit(" to "), later)).otherwise(start)
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.parse_range(raw, day).alias("r"))
    return r.select("l_orderkey", "l_linenumber", F.col("r.start").cast("string").alias("start"), F.col("r.end").cast("string").alias("finish"), "r.current", dates.duration_months(F.col("r.start"), F.col("r.end"), F.col("r.current"), day).cast("long").alias("months"))


# --- JSON --------------------------------------------------------------------------------------------------------


@register("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS found FROM events")
def json_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", documents.value(F.try_parse_json("props"), ("missing", "k")).alias("found"))


@register(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|b' WHEN 1 THEN 'a|' || event_type || '|c' ELSE '' END AS items FROM events"""
)
def json_list_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"s": [" ', event_type, '", "", "b "]}') WHEN 1 THEN concat('{"skills": null, "s": "a; ', event_type, ',,c"}') WHEN 2 THEN '{"s": 5}' ELSE '{}' END""")
    return table(spark, sf_dir, "events").select("event_id", joined(documents.strings(F.try_parse_json(doc), ("skills", "s"))).alias("items"))


_DOC = """concat('{"name": "', c_name, '", "email": "', replace(c_name, '#', '.'), '@example.com", "years_experience": "', c_acctbal, '", "skills": ["k8s", "reactjs", "', c_mktsegment, '"], "experience": [{"employer": "acme inc", "role": "', c_mktsegment, '", "from": "Jan 2020", "to": "now"}, 7], "github": "github.com/u', c_custkey, '"}')"""


@register(
    """SELECT c_custkey::VARCHAR AS entity_id, c_name AS full_name, lower(replace(c_name, '#', '.')) || '@example.com' AS emails, c_acctbal AS years, 1::BIGINT AS n_jobs, 'Acme INC' AS company, c_mktsegment AS title, true AS is_current, '2020-01-01' AS start_date,
'https://github.com/u' || c_custkey AS link, 3::BIGINT AS n_skills FROM customer"""
)
def map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.expr(_DOC.replace("c_acctbal", "string(c_acctbal)").replace("u', c_custkey", "u', string(c_custkey)")).alias("doc"))
    found = documents.from_json_rows(rows, F.col("k"), F.col("k"), F.col("doc"))
    c = mapping.map_canonical(found, AS_OF)
    job = F.get("experience", F.lit(0))
    return c.select(
        "entity_id", "full_name", joined(F.col("emails")).alias("emails"), F.col("years_of_experience").alias("years"), F.size("experience").cast("long").alias("n_jobs"), job["company"].alias("company"), job["title"].alias("title"),
        job["is_current"].alias("is_current"), job["start_date"].cast("string").alias("start_date"), F.get("social_links", F.lit(0))["url"].alias("link"), F.size("skills").cast("long").alias("n_skills"),
    )


# Documents whose entries vary in keys, gaps and values by the part they are made of.
_DOC_ENTRIES = """concat('{"education": [', CASE WHEN p_partkey % 7 = 0 THEN '3, ' ELSE '' END, '{', CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('"institution": "', p_brand, '", ') WHEN 2 THEN concat('"school": " ', p_brand, ' ", ') ELSE concat('"university": "', p_brand, '", ') END,
CASE p_partkey % 3 WHEN 0 THEN concat('"degree": "Master of ', p_type, '"') WHEN 1 THEN concat('"level": "B.Sc ', p_type, '"') ELSE '"degree_type": ""' END, ', "', CASE WHEN p_partkey % 2 = 0 THEN 'major' ELSE 'discipline' END, '": "', p_type, '", "startDate": "', 1960 + p_size, '-09", "', CASE WHEN p_partkey % 2 = 0 THEN 'graduation_date' ELSE 'end_date' END,
'": "', 1964 + p_size, '", "', CASE WHEN p_partkey % 2 = 0 THEN 'gpa' ELSE 'grade' END, '": "', p_size, CASE WHEN p_partkey % 2 = 0 THEN '/4.0' ELSE '' END, '", "honors": "', p_brand, ';  ; first"}], "projects": [', CASE WHEN p_partkey % 5 = 0 THEN '{"stars": "many"' ELSE concat('{"', CASE WHEN p_partkey % 2 = 0 THEN 'title' ELSE 'name' END, '": " ', p_name, ' ", "stars": ', p_size) END,
', "', CASE WHEN p_partkey % 2 = 0 THEN 'demo_url' ELSE 'live_url' END, '": "www.Example.com/p', p_partkey, '/", "github_url": "https://github.com/o/r', p_partkey, '", "open_source": ', CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"yes"' ELSE 'null' END, '}], "', CASE WHEN p_partkey % 2 = 0 THEN 'certificates' ELSE 'certifications' END, '": [{',
CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('"certification_name": "', p_type, '", ') ELSE concat('"name": "', p_type, '", ') END, '"issuer": "', p_brand, '", "issued_date": "', 2000 + p_size % 20, '-02-03", "expires": "Mar ', 2001 + p_size % 20, '", "license_number": ', p_partkey, ', "verify_url": "', CASE WHEN p_partkey % 3 = 0 THEN 'https:///nowhere' ELSE concat('https://v.example.com/', p_partkey) END, '"}]}')"""


@register(
    """SELECT p_partkey::VARCHAR AS entity_id, CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE p_brand END AS school, CASE p_partkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'bachelor' ELSE 'unknown' END AS degree, p_type AS field, (1960 + p_size) || '-09-01' AS school_start, (1964 + p_size) || '-01-01' AS school_end,
CASE WHEN p_size <= 4 THEN p_size::DOUBLE END AS gpa, p_brand || '|first' AS honors, CASE WHEN p_partkey % 5 = 0 THEN 'Untitled' ELSE p_name END AS project, 'https://www.example.com/p' || p_partkey AS url, 'https://github.com/o/r' || p_partkey AS repository, p_partkey % 4 IN (0, 2) AS open_source,
CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS stars, CASE WHEN p_partkey % 6 = 0 THEN 'Unknown' ELSE p_type END AS certificate, p_brand AS issuer, (2000 + p_size % 20) || '-02-03' AS issued, (2001 + p_size % 20) || '-03-01' AS expires, p_partkey::VARCHAR AS credential, CASE WHEN p_partkey % 3 <> 0 THEN 'https://v.example.com/' || p_partkey END AS credential_url FROM part"""
)
def map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education, projects and certificates of documents, read by any of their keys and mapped."""
    k = F.col("p_partkey").cast("string")
    found = mapping.map_canonical(documents.from_json_rows(table(spark, sf_dir, "part").withColumn("doc", F.expr(_DOC_ENTRIES)), k, k, F.col("doc")), AS_OF)
    school, own, paper = (F.get(n, F.lit(0)) for n in ("education", "projects", "certifications"))
    day = lambda c: c.cast("string")
    return found.select(
        "entity_id", school["institution"].alias("school"), school["degree"].alias("degree"), school["field_of_study"].alias("field"), day(school["start_date"]).alias("school_start"), day(school["end_date"]).alias("school_end"), school["gpa"].alias("gpa"), joined(school["honors"]).alias("honors"),
        own["name"].alias("project"), own["url"].alias("url"), own["repository_url"].alias("repository"), own["is_open_source"].alias("open_source"), own["stars"].cast("long").alias("stars"),
        paper["name"].alias("certificate"), paper["issuing_organization"].alias("issuer"), day(paper["issue_date"]).alias("issued"), day(paper["expiry_date"]).alias("expires"), paper["credential_id"].alias("credential"), paper["credential_url"].alias("credential_url"),
    )


# --- Sources -----------------------------------------------------------------------------------------------------


@register(
    """SELECT c_custkey::VARCHAR AS entity_id, c_name AS full_name, c_mktsegment AS company, CASE WHEN c_custkey % 2 = 0 THEN 'a|' || lower(c_mktsegment) ELSE lower(c_mktsegment) END AS skills, CASE WHEN c_custkey % 3 = 0 THEN 7.5::DOUBLE END AS years FROM customer"""
)
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit(" "), F.col("c_name")).alias(" Full Name"), F.col("c_mktsegment").alias("Employer"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('a ; ', lower(c_mktsegment), ';') ELSE lower(c_mktsegment) END").alias("Tech Stack"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN '7.5 years' WHEN c_custkey % 3 = 1 THEN '7+' ELSE 'nan' END").alias("YOE"),
    )
    found = delimited.from_rows(rows, F.col("id"), F.lit("rows"))
    return found.select("entity_id", "full_name", F.get("experience", F.lit(0))["company"].alias("company"), joined(F.col("skills_raw")).alias("skills"), F.col("years_of_experience").alias("years"))


@register(
    r"""SELECT c_custkey::VARCHAR AS entity_id, 'Jane Van-Dyke' AS full_name, 'Springfield, ' || c_mktsegment AS location, (c_custkey % 30)::DOUBLE AS years, 'u' || c_custkey || '@example.com' AS emails, '(415) 555-0198' AS phones,
'linkedin:https://linkedin.com/in/u' || c_custkey || '|github:https://github.com/u' || c_custkey AS links, 'docker|kubernetes|python' AS skills FROM customer"""
)
def notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.expr(r"""concat('Candidate: Jane Van-Dyke\nEmail: u', c_custkey, '@example.com\nPhone: (415) 555-0198\nLocation: Springfield, ', c_mktsegment, '\nKnows Python, Docker; Kubernetes, has ', c_custkey % 30, '+ years of experience. github.com/u', c_custkey, ' linkedin.com/in/u', c_custkey, ' u', c_custkey, '@example.com')""")
    found = prose.from_notes(table(spark, sf_dir, "customer").withColumn("note", note), F.col("c_custkey").cast("string"), F.lit("notes"), F.col("note"))
    links = F.transform("social_links", lambda x: F.concat_ws(":", x["platform"], x["url"]))
    return found.select("entity_id", "full_name", F.col("location_raw").alias("location"), F.col("years_of_experience").alias("years"), joined(F.col("emails")).alias("emails"), joined(F.col("phones")).alias("phones"), joined(links).alias("links"), joined(F.col("skills_raw")).alias("skills"))


@register(
    """SELECT c_custkey::VARCHAR AS entity_id, 'Jane Q Smith' AS full_name, 'Works in ' || c_mktsegment || '.' AS summary, 'Python|Go|' || lower(c_mktsegment) AS skills, 2::BIGINT AS n_jobs, 'Acme' AS company, c_mktsegment AS title, 'Jan 2019' AS started, 'Present' AS ended, true AS is_current,
'Engineer' AS second_title, 'State University' AS school, 'B.S in Weaving' AS degree, 'Weaving' AS field, '2018' AS graduated FROM customer"""
)
def resume_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.expr(
        r"""concat('Jane Q Smith\nu', c_custkey, '@example.com\n\nSUMMARY\nold\nSummary:\nWorks  in\n', c_mktsegment, '.\nSkills\n• Python | Go\n- ', lower(c_mktsegment), '\nWork Experience\nAcme | ', c_mktsegment, '\nJan 2019 – Present\nDid things\nand more\n\n\nEngineer at Beta\n2010 - 2012\nEducation\nState University\nB.S in Weaving\n2018\n')"""
    )
    found = prose.from_resumes(table(spark, sf_dir, "customer").withColumn("cv", cv), F.col("c_custkey").cast("string"), F.lit("cv"), F.col("cv"))
    one, two, school = F.get("experience", F.lit(0)), F.get("experience", F.lit(1)), F.get("education", F.lit(0))
    return found.select(
        "entity_id", "full_name", "summary", joined(F.col("skills_raw")).alias("skills"), F.size("experience").cast("long").alias("n_jobs"), one["company"].alias("company"), one["title"].alias("title"), one["start_raw"].alias("started"), one["end_raw"].alias("ended"),
        one["is_current"].alias("is_current"), two["title"].alias("second_title"), school["institution"].alias("school"), school["degree_raw"].alias("degree"), school["field_of_study"].alias("field"), school["end_raw"].alias("graduated"),
    )


@register(
    """SELECT c_custkey, 'header' AS section, 'Jane' AS content FROM customer UNION ALL SELECT c_custkey, 'summary', 'again ' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'skills', 'python, ' || c_mktsegment FROM customer"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.expr(r"concat('\nJane\n Professional  Summary \nfirst\nSkills:\npython, ', c_mktsegment, '\n\nsummary\n\nagain ', c_custkey, '\n')")
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(prose.sections(cv)).alias("section", "content"))


_REPOS = "SELECT user_id::VARCHAR AS login, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS pos, event_type, event_id, floor(value) AS stars FROM events"


@register(f"WITH r AS ({_REPOS}) SELECT login, event_id, stars::BIGINT AS stars, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY login ORDER BY stars DESC, pos) AS rank FROM r WHERE event_type <> 'error') WHERE rank <= 10")
def topk_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lookups.top_rows(_repos(spark, sf_dir).where("event_type <> 'error'"), "login", [F.desc("stars"), F.col("pos")], profiles.MOST_PROJECTS)
    return own.select("login", "event_id", F.col("stars").cast("long").alias("stars"), F.col("rank").cast("long").alias("rank"))


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("login"), (F.row_number().over(last) - 1).alias("pos"), "event_type", "event_id", F.floor("value").alias("stars"))


@register(f"WITH r AS ({_REPOS}), c AS (SELECT login, event_type, count(*) AS n, min(pos) AS pos FROM r WHERE pos < 30 GROUP BY ALL) SELECT login, string_agg(event_type, '|' ORDER BY n DESC, pos) AS skills FROM c GROUP BY login")
def language_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = _repos(spark, sf_dir).where(F.col("pos") < profiles.MOST_REPOS).withColumn("language", F.col("event_type"))
    return profiles.language_skills(repos).select("login", joined(F.col("skills")).alias("skills"))


@register(
    f"""WITH r AS ({_REPOS}), own AS (SELECT login, event_id, row_number() OVER (PARTITION BY login ORDER BY stars DESC, pos) AS rank FROM r WHERE pos < 30 AND event_type <> 'error')
SELECT login AS entity_id, 'User ' || login AS full_name, string_agg('r' || event_id, '|' ORDER BY rank) FILTER (rank <= 10) AS projects, 'github:https://github.com/' || login || '|portfolio:https://u' || login || '.example.com' AS links FROM own GROUP BY login"""
)
def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _repos(spark, sf_dir)
    none = F.lit(None).cast("string")
    repos = r.select(
        "login", "pos", F.concat(F.lit("r"), F.col("event_id")).alias("name"), none.alias("description"), none.alias("html_url"), none.alias("homepage"), F.col("event_type").alias("language"), F.array("event_type").alias("topics"),
        F.col("stars").cast("int").alias("stargazers_count"), F.lit(0).alias("forks_count"), (F.col("event_type") == "error").alias("fork"), F.lit(False).alias("private"),
    )
    zero = F.lit(0)
    people_ = repos.where((F.col("pos") < 30) & ~F.col("fork")).select("login").distinct().select(
        "login", F.concat(F.lit("User "), F.col("login")).alias("name"), none.alias("bio"), none.alias("email"), none.alias("location"), F.concat(F.lit("u"), F.col("login"), F.lit(".example.com")).alias("blog"), none.alias("twitter_username"),
        zero.alias("public_repos"), zero.alias("followers"), zero.alias("following"), zero.alias("public_gists"),
    )
    found = profiles.from_tables(people_, repos)
    links = F.transform("social_links", lambda x: F.concat_ws(":", x["platform"], x["url"]))
    return found.select("entity_id", "full_name", joined(F.transform("projects", lambda x: x["name"])).alias("projects"), joined(links).alias("links"))


# --- Mapping, validation, projection -----------------------------------------------------------------------------


def _orders_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged-like records: customers with their orders as jobs, contact data that is partly wrong."""
    start = F.to_date("o_orderdate")
    job = F.struct(
        F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title"), F.lit(None).cast(places.PLACE).alias("location"), start.alias("start_date"),
        F.when(F.expr("o_orderkey % 5 = 0"), F.date_sub(start, 30)).when(F.expr("o_orderkey % 5 = 1"), F.date_add(start, 400)).alias("end_date"), F.expr("o_orderkey % 5 = 2").alias("is_current"),
        F.lit(None).cast("string").alias("description"), arrays.no_strings().alias("responsibilities"), arrays.no_strings().alias("technologies"), arrays.no_strings().alias("achievements"),
    )
    jobs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", job.alias("j")))), lambda x: x["j"]).alias("jobs"))
    c = table(spark, sf_dir, "customer").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return as_canonical(
        c,
        "ats",
        F.col("c_custkey").cast("string"),
        full_name=F.expr("CASE WHEN c_custkey % 10 <> 0 THEN c_name END"),
        emails=F.expr("CASE c_custkey % 3 WHEN 0 THEN array('bad@', 'a@b.co') WHEN 1 THEN array('a@b.co') END"),
        phones=F.expr("CASE c_custkey % 4 WHEN 0 THEN array('+14155550198') WHEN 1 THEN array('12') END"),
        experience=F.col("jobs"),
        social_links=F.expr("CASE WHEN c_custkey % 6 = 0 THEN array(named_struct('platform', 'other', 'url', 'nowhere', 'username', string(null))) END"),
        summary=F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END"),
    )


_JOBS = "jobs AS (SELECT c_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS i, o_orderdate::DATE AS s, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE - 30 WHEN 1 THEN o_orderdate::DATE + 400 END AS e FROM orders JOIN customer ON o_custkey = c_custkey)"
_FINDINGS = f"""WITH {_JOBS}, findings AS (
SELECT c_custkey::VARCHAR AS entity_id, 'error' AS severity, 'full_name' AS field, NULL AS value FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'contact', NULL FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 4 > 1
UNION ALL SELECT c_custkey::VARCHAR, 'error', 'emails', 'bad@' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'phones', '12' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey::VARCHAR, 'error', 'experience[' || i || '] (' || o_orderpriority || ').dates', s || ' > ' || e FROM jobs WHERE e < s
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'experience[' || i || '] (' || o_orderpriority || ').start_date', s::VARCHAR FROM jobs WHERE s > DATE '1997-06-01'
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'social_links[0].url', 'nowhere' FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'summary', NULL FROM customer WHERE c_custkey % 2 <> 0
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'skills', NULL FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'experience', NULL FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM jobs)
UNION ALL SELECT c_custkey::VARCHAR, 'warning', 'education', NULL FROM customer)"""


@register(f"{_FINDINGS} SELECT * FROM findings")
def validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.with_findings(_orders_as_jobs(spark, sf_dir), "1997-06-01")
    return validate.findings_rows(checked).select("entity_id", "severity", "field", "value")


@register(f"{_FINDINGS} SELECT entity_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS is_valid FROM findings GROUP BY entity_id")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.summary(validate.with_findings(_orders_as_jobs(spark, sf_dir), "1997-06-01"))
    return found.select("entity_id", F.col("errors").cast("long").alias("errors"), F.col("warnings").cast("long").alias("warnings"), "is_valid")


_SCHOOLS = """jobs AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderdate::DATE - CAST(o_orderkey % 3 * 10000 AS INTEGER) AS s, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate::DATE - CAST(o_orderkey % 3 * 10000 AS INTEGER) - 500 + CAST(o_orderkey % 1000 AS INTEGER) END AS e,
CASE WHEN o_orderkey % 3 <> 1 THEN (o_orderkey % 60)::DOUBLE / 10 - 1 END AS g FROM orders)"""


@register(
    f"""WITH {_SCHOOLS} SELECT o_custkey::VARCHAR AS entity_id, 'warning' AS severity, 'experience[' || i || '] (' || o_orderpriority || ').start_date' AS field, '{validate.TOO_EARLY}' AS message, s::VARCHAR AS value FROM jobs WHERE s < DATE '{validate.EARLIEST}'
UNION ALL SELECT o_custkey::VARCHAR, 'error', 'experience[' || i || '] (' || o_orderpriority || ').dates', '{validate.ENDS_FIRST}', s || ' > ' || e FROM jobs WHERE e < s
UNION ALL SELECT o_custkey::VARCHAR, 'error', 'education[' || i || '] (' || o_orderpriority || ').dates', '{validate.LEFT_FIRST}', s || ' > ' || e FROM jobs WHERE e < s
UNION ALL SELECT o_custkey::VARCHAR, 'error', 'education[' || i || '].gpa', '{validate.BAD_GPA}', g::VARCHAR FROM jobs WHERE g < 0 OR g > 4"""
)
def validate_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on dates and grades of jobs and schools, with their messages."""
    start = F.date_sub(F.to_date("o_orderdate"), F.expr("int(o_orderkey % 3 * 10000)"))
    end = F.when(F.expr("o_orderkey % 4 < 2"), F.date_add(F.date_sub(start, 500), F.expr("int(o_orderkey % 1000)")))
    none = F.lit(None).cast("string")
    school = F.struct(F.col("o_orderpriority").alias("institution"), none.alias("degree"), none.alias("field_of_study"), start.alias("start_date"), end.alias("end_date"), F.expr("CASE WHEN o_orderkey % 3 <> 1 THEN double(o_orderkey % 60) / 10 - 1 END").alias("gpa"), arrays.no_strings().alias("honors"))
    job = F.struct(
        F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title"), F.lit(None).cast(places.PLACE).alias("location"), start.alias("start_date"), end.alias("end_date"), F.lit(False).alias("is_current"), none.alias("description"),
        arrays.no_strings().alias("responsibilities"), arrays.no_strings().alias("technologies"), arrays.no_strings().alias("achievements"),
    )
    both = F.array_sort(F.collect_list(F.struct("o_orderkey", job.alias("j"), school.alias("s"))))
    people_ = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(both.alias("both"))
    records = as_canonical(people_, "ats", F.col("o_custkey").cast("string"), experience=F.transform("both", lambda x: x["j"]), education=F.transform("both", lambda x: x["s"]))
    found = validate.findings_rows(validate.with_findings(records, AS_OF)).where(F.col("field").rlike(r"^(experience|education)\["))
    return found.select("entity_id", "severity", "field", "message", "value")


@register(
    """SELECT page_id::VARCHAR AS entity_id, 'linkedin' AS platform, 'https://www.linkedin.com/in/u' || page_id AS url FROM pages UNION ALL SELECT page_id::VARCHAR, 'other', 'http://h' || page_id || '.example.com:8080/a' FROM pages"""
)
def mapper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr(
        """array(named_struct('platform', 'LinkedIn', 'url', concat('www.LinkedIn.com/in/u', page_id, '/?x=1'), 'username', string(null)), named_struct('platform', 'github', 'url', '', 'username', string(null)),
named_struct('platform', 'blog', 'url', concat('http://me@H', page_id, '.example.com:8080/a//#top'), 'username', string(null)), named_struct('platform', string(null), 'url', concat('https://www.linkedin.com/in/u', page_id), 'username', string(null)))"""
    )
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("entity_id"), F.explode(mapping.links(given)).alias("x"))
    return rows.select("entity_id", "x.platform", "x.url")


@register("SELECT c_custkey::VARCHAR AS entity_id, 'Spanish|' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS languages FROM customer")
def mapper_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.lit(" spanish "), F.col("c_mktsegment"), F.lit("SPANISH"), F.lit(""), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), joined(F.transform(mapping.languages(given), lambda x: x["name"])).alias("languages"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.with_confidence(confidence.with_provenance(merge.merge_records(people(spark, sf_dir))))


_SHOWN = ("years_of_experience", "full_name", "emails", "nonsense", "summary")


@register(
    f"""WITH {PEOPLE} SELECT entity_id, sha256(entity_id) AS candidate_id, arg_min(full_name, priority) AS full_name, coalesce(max(len(mails)) > 0, false) AS has_mail, CASE WHEN bool_or(source = 'notes') THEN true ELSE false END AS has_summary,
arg_min(years, priority) FILTER (years IS NOT NULL) AS years_of_experience FROM people GROUP BY entity_id"""
)
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = project.OutputConfig(output_fields=_SHOWN, include_confidence=False, include_provenance=False)
    out = project.project(_scored(spark, sf_dir), config, AS_OF)
    assert out.columns == ["entity_id", "candidate_id", "full_name", "emails", "summary", "years_of_experience"]
    return out.select("entity_id", "candidate_id", "full_name", (F.size("emails") > 0).alias("has_mail"), F.col("summary").isNotNull().alias("has_summary"), "years_of_experience")


def _members(null_handling: str) -> str:
    name = {"omit": "CASE WHEN notes THEN ',\"summary\":\"' || lang || '\"' ELSE '' END", "empty": "',\"summary\":\"' || coalesce(lang, '') || '\"'", "null": "',\"summary\":' || coalesce('\"' || lang || '\"', 'null')"}[null_handling]
    phones = "" if null_handling == "omit" else " || ',\"phones\":[]'"
    return f"""WITH {PEOPLE}, m AS (SELECT entity_id, arg_min(full_name, priority) AS full_name, bool_or(source = 'notes') AS notes FROM people GROUP BY entity_id)
SELECT entity_id, '{{"candidate_id":"' || sha256(entity_id) || '","full_name":"' || full_name || '"'{phones} || {name} || '}}' AS json FROM m LEFT JOIN (SELECT doc_id::VARCHAR AS entity_id, lang FROM documents) USING (entity_id)"""


def _rendered(spark: SparkSession, sf_dir: str, null_handling: str) -> DataFrame:
    config = project.OutputConfig(output_fields=("full_name", "phones", "summary"), include_confidence=False, include_provenance=False, include_metadata=False, null_handling=null_handling)
    return project.render(project.project(_scored(spark, sf_dir), config, AS_OF), config)


@register(_members("omit"))
def null_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "omit")


@register(_members("empty"))
def null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "empty")


@register(_members("null"))
def null_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "null")


@register(f"WITH {PEOPLE} SELECT entity_id, coalesce(arg_min(full_name, priority), 'Unknown') AS display_name, len(arg_min(mails, priority) FILTER (len(mails) > 0)) > 0 AS reachable, arg_min(mails[1], priority) FILTER (len(mails) > 0) AS primary_email FROM people GROUP BY entity_id")
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = text.display_name(F.col("full_name"), F.col("first_name"), F.col("last_name"))
    first = F.get("emails", F.lit(0))
    return merge.merge_records(people(spark, sf_dir)).select("entity_id", shown.alias("display_name"), F.when(first.isNotNull(), True).alias("reachable"), first.alias("primary_email"))


@register()
def fuse_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine over four sources; what it must give is tested entity by entity."""
    customers = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    docs = documents.from_json_rows(customers.where("c_custkey % 5 <> 0").withColumn("doc", F.expr(_DOC.replace("c_acctbal", "string(c_acctbal)").replace("u', c_custkey", "u', string(c_custkey)"))), k, k, F.col("doc"))
    rows = customers.where("c_custkey % 3 <> 0").select(k.alias("id"), F.upper("c_name").alias("name"), F.lit("acme").alias("company"), F.col("c_mktsegment").alias("title"), F.lit("Python|k8s").alias("skills"), F.lit("Austin, TX").alias("location"))
    listed = delimited.from_rows(rows, F.col("id"), F.lit("rows"))
    notes = prose.from_notes(customers.where("c_custkey % 4 = 0").withColumn("note", F.concat(F.lit("Name: Ann Lee\nLocation: Paris, France\nphone 415-555-0134, k8s, id "), k)), k, F.lit("notes"), F.col("note"))
    out = fuse(docs.unionByName(listed).unionByName(notes), as_of=AS_OF, metadata=False)
    # One pass over the profiles gives their JSON and the findings' counts.
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    counted = out.validated.withColumns({"errors": n(validate.ERROR), "warnings": n(validate.WARNING)})
    carry = ("errors", "warnings")
    return project.render(project.project(counted, out.config, AS_OF, carry), out.config, carry)
