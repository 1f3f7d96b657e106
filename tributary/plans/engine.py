"""The fusion engine: any number of sources and entities in, one profile per entity out."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.dims import SOURCES
from tributary.operators.confidence import with_confidence, with_provenance
from tributary.operators.mapping import map_canonical
from tributary.operators.merge import merge_records
from tributary.operators.project import OutputConfig, project, render, time_text
from tributary.operators.validate import ERROR, WARNING, findings_rows, summary, with_findings
from tributary.sources import delimited, documents, profiles, prose

log = logging.getLogger("tributary")
VERSION = "1.0.0"

Reader = Callable[..., DataFrame]
#: Readers by source; a source of one's own is one more entry.
READERS: dict[str, Reader] = {"ats": documents.read_documents, "csv": delimited.read_delimited, "resume": prose.read_resumes, "github": profiles.read_profiles, "notes": prose.read_notes}


def available_sources() -> list[str]:
    return list(READERS)


def reader(source: str) -> Reader:
    if source not in READERS:
        raise ValueError(f"no reader for source {source!r}; there are {', '.join(READERS)}")
    return READERS[source]


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Logs how long a step takes on the driver; what executors do is in Spark's own metrics."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info(json.dumps({"step": what, "ms": round((time.perf_counter() - began) * 1000, 1)}))


@dataclass
class Fused:
    """All stages' frames; nothing runs before one of them is asked for."""

    extracted: DataFrame
    canonical: DataFrame
    merged: DataFrame
    validated: DataFrame
    config: OutputConfig
    as_of: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def findings(self) -> DataFrame:
        return findings_rows(self.validated)

    @property
    def summary(self) -> DataFrame:
        return summary(self.validated)

    @property
    def status(self) -> DataFrame:
        """One row per entity and source: whether it was read, and why not."""
        return self.extracted.select("entity_id", "source", "raw_path", F.col("error").isNull().alias("succeeded"), "error")

    @property
    def projected(self) -> DataFrame:
        return project(self.validated, self.config, self.as_of)

    @property
    def json(self) -> DataFrame:
        return render(self.projected, self.config)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """JSON lines, one profile a line."""
        self.json.select("json").write.mode(mode).text(path)


def united(sources: list[DataFrame]) -> DataFrame:
    """All sources' rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def with_metadata(records: DataFrame, extracted: DataFrame, run_id: str, started: Column) -> DataFrame:
    """The records with ``metadata`` of the run: sources asked for, read and failed, and the findings' counts."""
    asked = extracted.groupBy("entity_id").agg(F.collect_set("source").alias("_asked"), F.collect_set(F.when(F.col("error").isNotNull(), F.col("source"))).alias("_failed"))
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    ranked = lambda c: F.filter(F.array(*(F.lit(s) for s in SOURCES)), lambda s: F.array_contains(c, s))
    made = F.struct(
        F.lit(run_id).alias("run_id"),
        F.lit(VERSION).alias("pipeline_version"),
        time_text(started).alias("started_at"),
        F.lit(None).cast("string").alias("completed_at"),
        F.lit(None).cast("double").alias("duration_ms"),
        ranked(F.col("_asked")).alias("sources_requested"),
        F.col("sources").alias("sources_succeeded"),
        ranked(F.col("_failed")).alias("sources_failed"),
        (n(ERROR) == 0).alias("validation_passed"),
        n(WARNING).alias("validation_warnings"),
        n(ERROR).alias("validation_errors"),
    )
    return records.join(asked, "entity_id", "left").withColumn("metadata", made).drop("_asked", "_failed")


def fuse(extracted: DataFrame, config: OutputConfig | None = None, as_of: str | None = None, strict: bool = False, metadata: bool = True, compose: bool = False) -> Fused:
    """Maps, merges, scores, validates and projects extracted records of any number of entities."""
    config = config or OutputConfig()
    canonical = map_canonical(extracted, as_of, compose)
    merged = with_confidence(with_provenance(merge_records(canonical)))
    validated = with_findings(merged, as_of, strict)
    out = Fused(extracted, canonical, merged, validated, config, as_of)
    if metadata and config.include_metadata:
        out.validated = with_metadata(validated, extracted, out.run_id, F.current_timestamp())
    return out


def fuse_files(spark: SparkSession, inputs: dict[str, object], config: str | Path | OutputConfig | None = None, entity: str = "entity", **options: object) -> Fused:
    """One entity described by several inputs (source: path, or users for profiles). A source that can't be read has an error row; ValueError if none can. A configuration that can't be read gives way to the default."""
    given = {s: v for s, v in ((s, inputs.get(s)) for s in READERS) if v}
    if not given:
        raise ValueError("no source is given")
    if not isinstance(config, OutputConfig):
        try:
            config = OutputConfig.read(config) if config else OutputConfig()
        except ValueError as e:
            log.warning("%s; the default is used", e)
            config = OutputConfig()
    frames = []
    for source, where in given.items():
        with timed(source):
            frames.append(read_one(spark, source, where, entity))
    extracted = united(frames)
    if not extracted.where(F.col("error").isNull()).limit(1).count():
        raise ValueError("no source could be read: " + "; ".join(r["error"] for r in extracted.select("error").collect()))
    return fuse(extracted, config, **options)


def read_one(spark: SparkSession, source: str, where: object, entity: str) -> DataFrame:
    """Extracted record of one source of one entity; the first row of a file of many."""
    try:
        if source == "github":
            user = profiles.user_of(str(where))
            if user is None:
                return failed(spark, source, entity, f"[{source}] no user in {where}")
            found = reader(source)(spark, [user]).withColumn("entity_id", F.lit(entity))
        else:
            found = reader(source)(spark, str(where), F.lit(entity))
        # In the order of the file, whatever task is done first.
        first = found.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(1).drop("_at")
        return first if found.limit(1).count() else failed(spark, source, entity, f"[{source}] no record in {where}")
    except Exception as e:  # whatever a reader meets, the other sources are still read
        log.warning("%s: %s", source, e)
        return failed(spark, source, entity, f"[{source}] {str(e).splitlines()[0]}")


def failed(spark: SparkSession, source: str, entity: str, error: str) -> DataFrame:
    from tributary.sources.schema import as_extracted

    return as_extracted(spark.range(1), source, entity_id=F.lit(entity), raw_path=F.lit(None), error=F.lit(error))
