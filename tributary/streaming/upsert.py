"""Fusion over streams: mapping is row-wise and runs on a stream as it is; the merge is brought up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.mapping import map_canonical
from tributary.plans.engine import Fused, fuse


def mapped_stream(extracted: DataFrame, as_of: str | None = None) -> DataFrame:
    """Canonical records of a stream of extracted ones."""
    return map_canonical(extracted, as_of)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The extracted record of each entity and source that the newest batch brought."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("entity_id", "source", "batch")]
    return rows.groupBy("entity_id", "source").agg(F.max_by(F.struct(*fields), F.struct("batch", F.xxhash64("raw_path", "full_name"))).alias("r")).select("entity_id", "source", "r.*")


def upsert(extracted: DataFrame, state: str, checkpoint: str, each: Callable[[Fused, int], None] | None = None, **options: object) -> StreamingQuery:
    """Appends each batch's records to ``state`` (partitioned by batch, so a batch that is run again replaces itself) and hands the profiles of the entities it touches to ``each``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").parquet(state)
        if each is not None:
            touched = spark.read.parquet(f"{state}/batch={number}").select("entity_id").distinct()
            each(fuse(latest(spark, state).join(touched, "entity_id", "left_semi"), **options), number)

    return extracted.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


