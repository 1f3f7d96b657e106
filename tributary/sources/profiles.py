"""Public code-host profiles and their repositories, as tables or over the network."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tributary.functions.dims import NO_SKILL
from tributary.functions.text import null_if_empty
from tributary.sources.delimited import fields
from tributary.sources.schema import RAW_LINK, RAW_PROJECT, as_extracted

# How many repositories are read, kept as projects, and of each how many topics and characters.
MOST_REPOS, MOST_PROJECTS, MOST_TOPICS, MOST_DESCRIPTION = 30, 10, 5, 500
# The service's retries, pause factor, retried statuses and time limit.
RETRIES, BACKOFF, RETRIED, TIMEOUT = 3, 1.5, (408, 429, 500, 502, 503, 504), 15

PROFILE = "login string, name string, bio string, email string, location string, blog string, twitter_username string, public_repos int, followers int, following int, public_gists int, error string"
REPO = "login string, pos int, name string, description string, html_url string, homepage string, language string, topics array<string>, stargazers_count int, forks_count int, fork boolean, private boolean"


def language_skills(repos: DataFrame) -> DataFrame:
    """(login, skills): languages by how many repositories use them, the first seen first among equals."""
    counted = repos.where(F.col("language").isNotNull() & (F.col("language") != "") & ~F.col("language").isin(*NO_SKILL)).groupBy("login", "language").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "language")))
    return counted.groupBy("login").agg(F.transform(ordered, lambda x: x["language"]).alias("skills"))


def top_projects(repos: DataFrame, most: int = MOST_PROJECTS) -> DataFrame:
    """(login, projects): own repositories with most stars, in the order of the table among equals. A login's repositories are few: MOST_REPOS are read."""

    def project(r: Column) -> Column:
        made = {
            "name": F.coalesce(r["name"], F.lit("")),
            "description": null_if_empty(F.substring(r["description"], 1, MOST_DESCRIPTION)),
            "url": null_if_empty(r["homepage"]),
            "repository_url": r["html_url"],
            "technologies": F.filter(F.concat(F.array(r["language"]), F.slice(F.coalesce(r["topics"], F.array().cast("array<string>")), 1, MOST_TOPICS)), lambda t: t != ""),
            "is_open_source": ~F.coalesce(r["private"], F.lit(False)),
            "stars": F.coalesce(r["stargazers_count"], F.lit(0)),
            "forks": F.coalesce(r["forks_count"], F.lit(0)),
        }
        return F.struct(*(made.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields(RAW_PROJECT)))

    names = [f.name for f in StructType.fromDDL(REPO).fields if f.name not in ("login", "pos")]
    own = repos.where(~F.coalesce("fork", F.lit(False)))
    held = F.array_sort(F.collect_list(F.struct((-F.coalesce("stargazers_count", F.lit(0))).alias("order"), "pos", *names)))
    return own.groupBy("login").agg(F.transform(F.slice(held, 1, most), project).alias("projects"))


def from_tables(profiles: DataFrame, repos: DataFrame, entity: Column | None = None) -> DataFrame:
    """Extracted records of profiles and their most recent repositories (pos: order by last push)."""
    recent = repos.where(F.col("pos") < MOST_REPOS)
    p = profiles.join(language_skills(recent), "login", "left").join(top_projects(recent), "login", "left")
    link = lambda platform, url: F.struct(F.lit(platform).alias("platform"), url.alias("url"), F.lit(None).cast("string").alias("username"))
    home = F.concat(F.lit("https://github.com/"), F.col("login"))
    blog, handle = null_if_empty(F.col("blog")), null_if_empty(F.col("twitter_username"))
    blog = F.when(F.startswith(blog, F.lit("http")), blog).otherwise(F.concat(F.lit("https://"), blog))
    links = F.array_compact(F.array(link("github", home), F.when(blog.isNotNull(), link("portfolio", blog)), F.when(handle.isNotNull(), link("twitter", F.concat(F.lit("https://twitter.com/"), handle)))))
    counts = F.create_map(*(c for n in ("public_repos", "followers", "following", "public_gists") for c in (F.lit(n), F.coalesce(F.col(n), F.lit(0)).cast("string"))))
    return as_extracted(
        p,
        "github",
        entity_id=entity if entity is not None else F.col("login"),
        raw_path=home,
        full_name=F.col("name"),
        emails=F.array_compact(F.array(null_if_empty(F.col("email")))),
        location_raw=F.col("location"),
        summary=F.col("bio"),
        skills_raw=F.col("skills"),
        projects=F.col("projects"),
        social_links=links.cast(f"array<{RAW_LINK}>"),
        extras=F.map_concat(F.create_map(F.lit("username"), F.col("login")), counts),
        error=F.col("error") if "error" in p.columns else F.lit(None).cast("string"),
    )


def service_error(status: int, headers: dict[str, str], url: str) -> str | None:
    """What an answer's status says, null if all is well."""
    if status == 200:
        return None
    if status == 404:
        return f"[github] user not found: {url}"
    if status in (403, 429):
        left, reset, wait = (headers.get(k, d) for k, d in (("X-RateLimit-Remaining", "?"), ("X-RateLimit-Reset", "?"), ("Retry-After", "unknown")))
        return f"[github] rate limit exceeded: remaining {left}, reset at {reset}, retry after {wait}"
    return f"[github] server error {status} for {url}" if status >= 500 else f"[github] unexpected status {status} for {url}"


def fetched(url: str, token: str | None, open_url=None, sleep=None) -> tuple[object, str | None]:
    """The JSON that a GET gives, or an error; retried with growing pauses."""
    import time
    import urllib.error
    import urllib.request

    open_url, sleep = open_url or urllib.request.urlopen, sleep or time.sleep
    request = urllib.request.Request(url, headers={"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    for attempt in range(RETRIES + 1):
        try:
            with open_url(request, timeout=TIMEOUT) as answer:
                return json.loads(answer.read()), None
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == RETRIES:
                return None, service_error(e.code, dict(e.headers or {}), url)
        except (OSError, ValueError) as e:
            if attempt == RETRIES:
                return None, f"[github] {e} for {url}"
        sleep(BACKOFF * 2**attempt)
    return None, f"[github] no answer from {url}"


def user_of(source: str) -> str | None:
    """User of a code-host URL, or the string itself if it is a plain name."""
    from urllib.parse import urlparse

    if "github.com" in source:
        parts = [p for p in urlparse(source if "://" in source else f"https://{source}").path.split("/") if p]
        return parts[0] if parts else None
    return source if source and "/" not in source else None


class ProfileSource(DataSource):
    """``spark.read.format("code_host_profiles").option("users", "a,b").load()``: a profile and its repositories as JSON for each user, one task each.

    Options: users, token, address (default the public service).
    """

    @classmethod
    def name(cls) -> str:
        return "code_host_profiles"

    def schema(self) -> str:
        return "login string, profile string, repos string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ProfileReader(dict(self.options))


class ProfileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.options.get("users", "").split(",") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top, token, user = self.options.get("address", "https://api.github.com"), self.options.get("token"), partition.value
        profile, error = fetched(f"{top}/users/{user}", token)
        repos, again = (None, None) if error else fetched(f"{top}/users/{user}/repos?sort=pushed&direction=desc&per_page={MOST_REPOS}&type=owner", token)
        yield user, json.dumps(profile), json.dumps(repos if isinstance(repos, list) else []), error or again


def read_profiles(spark: SparkSession, users: list[str], token: str | None = None, address: str | None = None) -> DataFrame:
    """Extracted records of users of the service."""
    spark.dataSource.register(ProfileSource)
    options = {"users": ",".join(users)} | ({"token": token} if token else {}) | ({"address": address} if address else {})
    return from_answers(spark.read.format(ProfileSource.name()).options(**options).load())


def from_answers(answers: DataFrame) -> DataFrame:
    """Extracted records of (login, profile, repos, error), the JSON that the service gave."""
    bare = StructType([f for f in StructType.fromDDL(PROFILE).fields if f.name not in ("login", "error")])
    repo = StructType([f for f in StructType.fromDDL(REPO).fields if f.name not in ("login", "pos")])
    profiles = answers.select("login", F.from_json("profile", bare).alias("p"), "error").select("login", "p.*", "error")
    repos = answers.select("login", F.posexplode(F.from_json("repos", f"array<{repo.simpleString()}>"))).select("login", "pos", "col.*")
    return from_tables(profiles, repos)
