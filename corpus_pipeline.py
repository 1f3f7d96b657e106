"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with
the columns of ``documents``; the last adds how many copies the mix takes.
Between stages ``run`` writes Parquet in the shared folder and reads it again,
so a lost executor costs a stage's tasks, not the stages before it. A stage's
files go once the next one has written its own; the last ones, which the result
reads, and those of a run that fails go when the driver ends.

Defined results: an empty table gives an empty one; a null text or one that the
base rules reject goes in the first stage; a null id is an id of its own; of
rows that are repeated one stays, and of near-duplicates that of the least id, null
only if all are; columns beyond those of documents are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import chunking, cube, fm_index, minhash, quality
from tributary.llm.textkit import gone_at_exit, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id."""
    return minhash.keep_one(docs.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that other documents hold as well are cut out of all but one."""
    return chunking.strip_repeats(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out."""
    return fm_index.remove_hits(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of copies."""
    return cube.materialise(docs.select(COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Likelihood ratios, signatures, chunk digests and the cube's random walk have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    gone_at_exit(spark, top)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if k:
            removed(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what a stage has written, once the next one has written its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
