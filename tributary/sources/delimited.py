"""Delimited files: one entity a row, columns found by their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.arrays import split_by_first
from tributary.sources.schema import RAW_EXPERIENCE, RAW_LINK, as_extracted

# Column names by which a field is known, first match wins.
ALIASES = {
    "first_name": ("first_name", "first name", "firstname", "given_name", "given name"),
    "last_name": ("last_name", "last name", "lastname", "surname", "family_name", "family name"),
    "full_name": ("full_name", "full name", "name", "candidate_name", "candidate name"),
    "email": ("email", "email_address", "email address", "e-mail", "e_mail"),
    "phone": ("phone", "phone_number", "phone number", "mobile", "mobile_number", "cell", "telephone"),
    "location": ("location", "city", "address", "location_raw"),
    "summary": ("summary", "bio", "about", "profile", "overview", "objective"),
    "skills": ("skills", "skill_set", "skill set", "technologies", "tech_stack", "tech stack", "expertise"),
    "current_company": ("current_company", "current company", "company", "employer", "organization"),
    "current_title": ("current_title", "current title", "title", "job_title", "job title", "position", "role"),
    "linkedin_url": ("linkedin", "linkedin_url", "linkedin url", "linkedin_profile", "linkedin profile"),
    "github_url": ("github", "github_url", "github url", "github_profile"),
    "years_experience": ("years_experience", "years experience", "experience_years", "experience years", "years_of_experience", "yoe"),
}
# Separators and encodings in the order they are tried, cells that mean nothing.
SEPARATORS = (",", ";", "\t", "|")
ENCODINGS = ("UTF-8", "ISO-8859-1")
NOTHING = ("", "NA", "N/A", "NULL", "None", "nan")


def column_map(columns: list[str]) -> dict[str, str]:
    """Field to the file's column, by the first alias that the file has."""
    there = {c.lower().strip(): c for c in columns}
    return {field: there[a] for field, names in ALIASES.items() for a in [next((a for a in names if a in there), None)] if a}


def cell(c: Column) -> Column:
    """Trimmed; null for cells that mean nothing."""
    value = F.trim(c)
    return F.when(~(c.isin(*NOTHING) | F.lower(value).isin("nan", "none", "null", "")), value)


#: The mark before some UTF-8 files.
MARK = "\ufeff"


def sniffed(spark: SparkSession, path: str) -> tuple[str, str, bool] | None:
    """Encoding that all lines are in, separator under which the header has more than one column, and whether a quoted cell may go over several lines: some line has an odd number of quotes."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    header = (first[0][0] or "").lstrip(MARK) if first else ""
    sep = next((s for s in SEPARATORS if len(header.split(s)) > 1), None)
    if sep is None:
        return None
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.agg(F.bool_or(~F.is_valid_utf8("value")).alias("odd"), F.bool_or(quotes % 2 == 1).alias("over")).first()
    return ENCODINGS[1 if found["odd"] else 0], sep, bool(found["over"])


def row_id(path: Column, *content: Column) -> Column:
    """An id for a row of a file of many entities: its file and its content, so that only equal rows share it."""
    return F.concat(path, F.lit("#"), F.lower(F.hex(F.xxhash64(*content))))


def read_delimited(spark: SparkSession, path: str, entity: Column | None = None) -> DataFrame:
    """Extracted records of a file or folder of files, a row an entity unless one is given; a file of fewer than two columns gives one row with an error. Files are split among tasks, unless a cell goes over several lines."""
    found = sniffed(spark, path)
    if found is None:
        one = spark.range(1).select(F.lit(path).alias("raw_path"))
        return as_extracted(one, "csv", entity_id=entity if entity is not None else F.lit(path), raw_path=F.col("raw_path"), error=F.concat(F.lit("[csv] no separator gives more than one column: "), F.col("raw_path")))
    encoding, sep, over = found
    rows = spark.read.csv(path, header=True, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, inferSchema=False, multiLine=over, escape='"', enforceSchema=False)
    renamed = rows.toDF(*(c.lstrip(MARK) for c in rows.columns))
    own = row_id(F.lit(path), *(F.col(f"`{c}`") for c in renamed.columns))
    return from_rows(renamed, entity if entity is not None else own, F.lit(path))


def from_rows(rows: DataFrame, entity: Column, path: Column) -> DataFrame:
    """Extracted records of a frame whose columns go by any of the aliases."""
    at = column_map(rows.columns)
    get = lambda f: cell(F.col(f"`{at[f]}`").cast("string")) if f in at else F.lit(None).cast("string")
    company, title = get("current_company"), get("current_title")
    job = F.struct(company.alias("company"), title.alias("title"), F.lit(True).alias("is_current"))
    filled = F.array(F.struct(*((job[n] if n in ("company", "title", "is_current") else F.lit(None).cast(k)).alias(n) for n, k in fields(RAW_EXPERIENCE))))
    link = lambda platform, url: F.when(url.isNotNull(), F.struct(F.lit(platform).alias("platform"), url.alias("url"), F.lit(None).cast("string").alias("username")))
    return as_extracted(
        rows,
        "csv",
        entity_id=entity,
        raw_path=path,
        full_name=get("full_name"),
        first_name=get("first_name"),
        last_name=get("last_name"),
        emails=F.array_compact(F.array(get("email"))),
        phones=F.array_compact(F.array(get("phone"))),
        location_raw=get("location"),
        summary=get("summary"),
        skills_raw=split_by_first(get("skills"), ("|", ";", ",")),
        experience=F.when(company.isNotNull() | title.isNotNull(), filled.cast(f"array<{RAW_EXPERIENCE}>")),
        social_links=F.array_compact(F.array(link("linkedin", get("linkedin_url")), link("github", get("github_url")))).cast(f"array<{RAW_LINK}>"),
        years_of_experience=F.get(F.split(get("years_experience"), r"\s+"), F.lit(0)).try_cast("double"),
    )


def fields(struct: str) -> list[tuple[str, str]]:
    """Names and types of a struct's fields."""
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(struct.removeprefix("struct<").removesuffix(">")).fields]
