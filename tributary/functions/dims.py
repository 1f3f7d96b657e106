"""Lookup values of the fusion engine, and how tables of them are made."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sources by priority, with their base confidence. Any other source comes last with 0.5.
SOURCES = {"ats": 0.95, "csv": 0.92, "resume": 0.90, "github": 0.80, "notes": 0.70}
OTHER_WEIGHT = 0.5

# How much a field counts in the overall confidence. Any other field counts 0.5.
IMPORTANCE = {
    "full_name": 1.0,
    "emails": 1.0,
    "phones": 0.8,
    "location": 0.7,
    "summary": 0.6,
    "skills": 0.9,
    "experience": 0.9,
    "education": 0.8,
    "projects": 0.5,
    "certifications": 0.5,
    "social_links": 0.4,
    "languages": 0.3,
    "headline": 0.5,
    "years_of_experience": 0.7,
}
OTHER_IMPORTANCE = 0.5

# Changes to a field's confidence, and the bounds of the high and low lists.
AGREEMENT, DISAGREEMENT = 0.05, 0.10
HIGH, LOW = 0.90, 0.70

# Similarity from which entries are the same.
COMPANY, TITLE, INSTITUTION, PROJECT, CERTIFICATION, SKILL = 80, 60, 80, 85, 85, 85

# Country names and their ISO 3166-1 codes.
COUNTRIES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.a.": "US", "us": "US", "canada": "CA",
    "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB", "india": "IN", "germany": "DE", "france": "FR",
    "australia": "AU", "netherlands": "NL", "singapore": "SG", "japan": "JP", "china": "CN", "brazil": "BR", "mexico": "MX",
    "spain": "ES", "italy": "IT", "sweden": "SE", "norway": "NO", "denmark": "DK", "switzerland": "CH", "new zealand": "NZ",
    "ireland": "IE", "portugal": "PT", "poland": "PL", "ukraine": "UA", "russia": "RU", "south korea": "KR", "korea": "KR",
    "taiwan": "TW", "israel": "IL", "uae": "AE", "united arab emirates": "AE", "south africa": "ZA", "argentina": "AR",
    "colombia": "CO", "chile": "CL", "indonesia": "ID", "malaysia": "MY", "philippines": "PH", "vietnam": "VN", "thailand": "TH",
    "pakistan": "PK", "bangladesh": "BD", "nigeria": "NG", "kenya": "KE",
}

# Abbreviations of US states.
STATES = {
    "al": "Alabama", "ak": "Alaska", "az": "Arizona", "ar": "Arkansas", "ca": "California", "co": "Colorado", "ct": "Connecticut",
    "de": "Delaware", "fl": "Florida", "ga": "Georgia", "hi": "Hawaii", "id": "Idaho", "il": "Illinois", "in": "Indiana", "ia": "Iowa",
    "ks": "Kansas", "ky": "Kentucky", "la": "Louisiana", "me": "Maine", "md": "Maryland", "ma": "Massachusetts", "mi": "Michigan",
    "mn": "Minnesota", "ms": "Mississippi", "mo": "Missouri", "mt": "Montana", "ne": "Nebraska", "nv": "Nevada", "nh": "New Hampshire",
    "nj": "New Jersey", "nm": "New Mexico", "ny": "New York", "nc": "North Carolina", "nd": "North Dakota", "oh": "Ohio", "ok": "Oklahoma",
    "or": "Oregon", "pa": "Pennsylvania", "ri": "Rhode Island", "sc": "South Carolina", "sd": "South Dakota", "tn": "Tennessee",
    "tx": "Texas", "ut": "Utah", "vt": "Vermont", "va": "Virginia", "wa": "Washington", "wv": "West Virginia", "wi": "Wisconsin",
    "wy": "Wyoming", "dc": "District of Columbia", "remote": "Remote",
}

# Places that mean no place, words for an open end, legal forms of companies.
REMOTE = ("remote", "fully remote", "work from home", "wfh", "anywhere")
PRESENT = ("present", "current", "now", "ongoing", "today", "till date", "till now", "to date")
STILL = ("present", "current", "now", "ongoing")
LEGAL_FORMS = ("llc", "inc", "ltd", "corp", "co", "ag", "gmbh", "sa", "plc")

# Words that tell a degree, first match wins.
DEGREES = (
    ("phd", "phd"), ("ph.d", "phd"), ("doctor", "phd"), ("mba", "mba"), ("master", "master"), ("m.s", "master"), ("m.sc", "master"),
    ("ms ", "master"), ("bachelor", "bachelor"), ("b.s", "bachelor"), ("b.sc", "bachelor"), ("b.a", "bachelor"), ("bs ", "bachelor"),
    ("ba ", "bachelor"), ("associate", "associate"), ("a.s", "associate"), ("bootcamp", "bootcamp"), ("boot camp", "bootcamp"),
    ("high school", "high_school"), ("diploma", "high_school"), ("certification", "certification"), ("certificate", "certification"),
)

# Platforms of social links, and what their URLs hold.
PLATFORMS = ("linkedin", "github", "twitter", "portfolio", "stackoverflow", "other")
PLATFORM_PATTERNS = (("linkedin", r"linkedin\.com/in/"), ("github", r"github\.com/"), ("twitter", r"(twitter|x)\.com/"), ("stackoverflow", r"stackoverflow\.com/users/"))

# Repository languages that are no skill.
NO_SKILL = ("Makefile", "Dockerfile", "Shell", "Batchfile", "CMake")

# Months by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def lookup(table: dict[str, object], key: Column) -> Column:
    """The table's value for a key, null if it has none; a literal map that Catalyst folds."""
    entries = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.when(key.isNotNull(), F.try_element_at(entries, key))


def priority(source: Column) -> Column:
    """0 for the first source; sources that aren't listed come after all."""
    return F.coalesce(lookup({s: i for i, s in enumerate(SOURCES)}, source), F.lit(len(SOURCES)))


def weight(source: Column) -> Column:
    return F.coalesce(lookup(SOURCES, source), F.lit(OTHER_WEIGHT))


def importance(field: Column) -> Column:
    return F.coalesce(lookup(IMPORTANCE, field), F.lit(OTHER_IMPORTANCE))
