"""Free-text notes and résumé text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import contact
from tributary.functions.arrays import no_strings
from tributary.functions.skills import alias_table
from tributary.functions.text import null_if_empty
from tributary.sources.delimited import fields
from tributary.sources.schema import RAW_EDUCATION, RAW_EXPERIENCE, RAW_LINK, as_extracted

# Labelled lines of notes. A name stays on its line.
NAME = r"(?i:candidate|name|candidate\s+name)[ \t]*:[ \t]*([A-Za-z][a-zA-Z\-']+(?:[ \t]+[A-Za-z][a-zA-Z\-']+){1,3})"
LOCATION = r"(?i)(?:location|city|based\s+in|located\s+in)\s*:\s*([^\n,]+(?:,\s*[^\n]+)?)"
YEARS = r"(?i)(\d+(?:\.\d+)?)\+?\s*years?\s+(?:of\s+)?(?:experience|exp)"

# Header lines of a résumé's sections.
SECTIONS = {
    "experience": r"(?:work\s+)?(?:experience|employment|work\s+history|professional\s+background|career)",
    "education": r"(?:education|academic|academic\s+background|qualifications|educational\s+background)",
    "skills": r"(?:skills?|technical\s+skills?|core\s+competenc(?:y|ies)|expertise|technologies|proficiencies)",
    "summary": r"(?:summary|profile|about\s+me|professional\s+summary|objective|career\s+objective|executive\s+summary)",
    "projects": r"(?:projects?|personal\s+projects?|side\s+projects?|open\s+source)",
    "certifications": r"(?:certifications?|licenses?|credentials?|certificates?)",
}
# A range of dates in a résumé, bullets, separators of a skills line, words that tell a degree.
DATE_RANGE = r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*[\s,]+\d{4}|\d{4})\s*[–\-—]\s*((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*[\s,]+\d{4}|\d{4}|present|current|now)"
BULLETS = " •·-–—*►▪"
SKILL_SEPARATORS = (",", "|", "•", ";", "/")
DEGREE_WORDS = r"(?i)ph\.d|phd|doctor|master|m\.s|m\.sc|mba|bachelor|b\.s|b\.sc|b\.a|associate|a\.s|bootcamp|boot camp|high school|diploma"
URL = r"(?i)https?://[^\s,<>\"']+"

LEAST_NOTES, LEAST_RESUME, NOTES_SUMMARY = 10, 50, 2000


def links_in(text: Column) -> Column:
    """Profiles in the order they are named, the professional network's first."""

    def of(platform: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda u: F.struct(F.lit(platform).alias("platform"), F.concat(F.lit("https://"), u).alias("url"), F.lit(None).cast("string").alias("username")))

    return F.concat(of("linkedin", contact.LINKEDIN), of("github", contact.GITHUB)).cast(f"array<{RAW_LINK}>")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return null_if_empty(F.trim(F.regexp_extract(text, pattern, group)))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Terms of a dictionary that stand in a text between word boundaries, in order of the dictionary. The text is searched as a whole for each term before any pattern runs, so few patterns do."""
    low = F.lower(text)
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, t) & F.rlike(low, F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b"))))


def from_notes(rows: DataFrame, entity: Column, path: Column, text: Column, terms: list[str] | None = None) -> DataFrame:
    """Extracted records of notes, one text a row."""
    known = sorted(terms if terms is not None else alias_table())
    error = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_NOTES, F.concat(F.lit("[notes] empty: "), path))
    return as_extracted(
        rows,
        "notes",
        entity_id=entity,
        raw_path=path,
        full_name=first_match(text, NAME),
        emails=contact.found(text, contact.EMAIL),
        phones=contact.found(text, contact.PHONE),
        location_raw=first_match(text, LOCATION),
        years_of_experience=first_match(text, YEARS).try_cast("double"),
        skills_raw=terms_in(text, known),
        social_links=links_in(text),
        summary=F.substring(F.trim(text), 1, NOTES_SUMMARY),
        error=error,
    )


def section_of(line: Column) -> Column:
    """The section whose header a line is, null for other lines."""
    out = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS.items()):
        out = F.when(line.rlike(rf"(?i)^\s*{words}\s*:?\s*$"), name).otherwise(out)
    return out


def sections(text: Column) -> Column:
    """Map of section to its lines. Lines before the first header are ``header``; of repeated headers the last holds."""
    lines = F.split(text, "\n")
    state = F.struct(F.lit("header").alias("now"), F.lit("").alias("held"), F.create_map().cast("map<string,string>").alias("done"))
    closed = lambda s: F.map_concat(F.map_filter(s["done"], lambda k, _: k != s["now"]), F.create_map(s["now"], F.trim(s["held"])))

    def step(s: Column, line: Column) -> Column:
        head = section_of(line)
        kept = F.when((s["now"] == "header") & (F.trim(line) == ""), s["held"]).otherwise(F.concat(s["held"], line, F.lit("\n")))
        return F.when(head.isNotNull(), F.struct(head.alias("now"), F.lit("").alias("held"), closed(s).alias("done"))).otherwise(F.struct(s["now"].alias("now"), kept.alias("held"), s["done"].alias("done")))

    return F.transform_values(F.reduce(lines, state, step, closed), lambda _, v: F.regexp_replace(v, r"^\s+|\s+$", ""))


def squeezed(c: Column) -> Column:
    return null_if_empty(F.trim(F.regexp_replace(c, r"\s+", " ")))


def name_line(text: Column) -> Column:
    """The first of the first five lines that reads like a name: two to four capitalised words, no contact data, no header."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)

    def like(line: Column) -> Column:
        parts = F.split(line, r"\s+")
        return ~line.rlike(contact.EMAIL) & ~line.rlike(contact.PHONE) & ~line.rlike(URL) & section_of(line).isNull() & F.size(parts).between(2, 4) & F.forall(parts, lambda w: w.rlike(r"^\p{Lu}"))

    return F.get(F.filter(lines, like), F.lit(0))


def section_skills(section: Column) -> Column:
    strip = lambda c: F.btrim(c, F.lit(BULLETS))

    def parts(line: Column) -> Column:
        out = F.array(line)
        for s in reversed(SKILL_SEPARATORS):
            out = F.when(F.contains(line, F.lit(s)), F.transform(F.split(line, "\\" + s), strip)).otherwise(out)
        return out

    lines = F.filter(F.transform(F.split(section, "\n"), strip), lambda x: x != "")
    return F.filter(F.flatten(F.transform(lines, parts)), lambda s: (F.length(s) > 1) & (F.length(s) < 80))


def blocks(section: Column) -> Column:
    """Trimmed lines of each block between blank lines."""
    each = F.transform(F.split(section, r"\n{2,}"), lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.filter(each, lambda b: F.size(b) > 0)


def section_jobs(section: Column) -> Column:
    """``Company | Title`` or ``Title at Company``, then dates or the title, then prose."""

    def job(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        bar, at = F.contains(first, F.lit("|")), first.rlike(r"(?i) at ")
        # A function of the line alone, evaluated where the block is: no group of the pattern can be empty.
        left = F.when(bar, F.trim(F.regexp_extract(first, r"^([^|]*)\|", 1))).when(at, F.trim(F.regexp_extract(first, r"(?i)^(.*?) at ", 1)))
        right = F.when(bar, F.trim(F.regexp_extract(first, r"^[^|]*\|(.*)$", 1))).when(at, F.trim(F.regexp_extract(first, r"(?i)^.*? at (.*)$", 1)))
        dated = F.coalesce(second.rlike(DATE_RANGE), F.lit(False))
        title = F.when(bar, right).when(at, left)
        end = F.when(dated, F.regexp_extract(second, DATE_RANGE, 2))
        made = {
            "company": F.when(bar, left).when(at, right).otherwise(first),
            "title": F.coalesce(null_if_empty(title), F.when(~dated, second)),
            "start_raw": F.when(dated, F.regexp_extract(second, DATE_RANGE, 1)),
            "end_raw": end,
            "is_current": F.coalesce(F.lower(end).isin("present", "current", "now"), F.lit(False)),
            "description": F.when(F.size(lines) > 2, F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(3))), " ")),
        }
        return F.struct(*(F.coalesce(made.get(n, F.lit(None)).cast(k), F.array().cast(k)).alias(n) if k.startswith("array") else made.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields(RAW_EXPERIENCE)))

    return F.transform(blocks(section), job)


def section_schools(section: Column) -> Column:
    """The institution, then a line with a degree, its field after ``in`` or a comma, and a year."""

    def school(lines: Column) -> Column:
        more = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        degrees = F.filter(more, lambda x: x.rlike(DEGREE_WORDS))
        degree = F.get(degrees, F.size(degrees) - 1)
        field = F.when(degree.rlike("(?i) in "), F.trim(F.regexp_extract(degree, "(?i) in (.*)$", 1))).when(F.contains(degree, F.lit(", ")), F.trim(F.regexp_extract(degree, ", (.*)$", 1)))
        dated = F.filter(more, lambda x: x.rlike(r"\b(19|20)\d{2}\b"))
        made = {"institution": F.get(lines, F.lit(0)), "degree_raw": degree, "field_of_study": field, "end_raw": null_if_empty(F.regexp_extract(F.get(dated, F.lit(0)), r"\b((?:19|20)\d{2})\b", 1))}
        return F.struct(*(F.coalesce(made.get(n, F.lit(None)).cast(k), F.array().cast(k)).alias(n) if k.startswith("array") else made.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields(RAW_EDUCATION)))

    return F.transform(blocks(section), school)


def from_resumes(rows: DataFrame, entity: Column, path: Column, text: Column) -> DataFrame:
    """Extracted records of résumé text, one a row. Text comes from whatever reads the files; PDF bytes need a library that the cluster brings (see pdf_text)."""
    parsed = rows.withColumns({"_text": F.coalesce(text, F.lit("")), "_path": path, "_entity": entity}).withColumn("_sections", sections(F.col("_text")))
    text, part = F.col("_text"), lambda name: F.coalesce(F.try_element_at(F.col("_sections"), F.lit(name)), F.lit(""))
    return as_extracted(
        parsed,
        "resume",
        entity_id=F.col("_entity"),
        raw_path=F.col("_path"),
        full_name=name_line(text),
        emails=contact.found(text, contact.EMAIL),
        phones=contact.found(text, contact.PHONE),
        summary=squeezed(part("summary")),
        skills_raw=section_skills(part("skills")),
        experience=section_jobs(part("experience")),
        education=section_schools(part("education")),
        social_links=links_in(text),
        error=F.when(F.length(F.trim(text)) < LEAST_RESUME, F.concat(F.lit("[resume] too little text: "), F.col("_path"))),
    )


def pdf_text(content: Column, most_pages: int = 50) -> Column:
    """Text of PDF bytes, pages joined by line breaks, through whichever of two libraries the executors have; null where neither can read it."""
    @F.pandas_udf("string")
    def read(rows: pd.Series) -> pd.Series:
        import io

        def first(data: bytes) -> str | None:
            try:
                import pdfplumber

                with pdfplumber.open(io.BytesIO(data)) as doc:
                    return "\n".join(p.extract_text() or "" for p in doc.pages[:most_pages])
            except Exception:
                return None

        def second(data: bytes) -> str | None:
            try:
                import fitz

                with fitz.open(stream=data, filetype="pdf") as doc:
                    return "\n".join(doc[i].get_text() for i in range(min(most_pages, len(doc))))
            except Exception:
                return None

        return rows.map(lambda d: None if d is None else first(d) or second(d))

    return read(content)


def read_notes(spark: SparkSession, path: str, entity: Column | None = None) -> DataFrame:
    """Extracted records of text files, one note a file; bytes that aren't UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode(F.col("content"), "ISO-8859-1"))
    return from_notes(files, entity if entity is not None else F.col("path"), F.col("path"), F.regexp_replace(text, "^﻿", ""))


def read_resumes(spark: SparkSession, path: str, entity: Column | None = None) -> DataFrame:
    """Extracted records of PDF files, or of text files that were made of them."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.lower(F.col("path")).endswith(".pdf"), pdf_text(F.col("content"))).otherwise(F.decode(F.col("content"), "UTF-8"))
    return from_resumes(files, entity if entity is not None else F.col("path"), F.col("path"), text)
