"""Jobs that arrive as files, taken in once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlake.operators.references import existence_deltas, fold, reference_deltas
from paperlake.schemas import CRAWLER_JOBS


def job_stream(spark: SparkSession, folder: str, files_per_batch: int = 100, name_filter: str = "*.parquet") -> DataFrame:
    """New rows of a folder of job files; files_per_batch paces the intake."""
    return (
        spark.readStream.schema(CRAWLER_JOBS)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", name_filter)
        .parquet(folder)
    )


def take_in(jobs: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that gives every batch to `run` and ends when all files are taken in.

    The checkpoint makes each file part of one batch only; a batch may be given
    again after a failure, with the same number.
    """
    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(jobs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeated jobs that arrive within a delay; what is older leaves the state."""
    timed = jobs.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(["_id"]).drop("_at")


def reference_state(before: DataFrame | None, children: DataFrame | None = None, parents: DataFrame | None = None,
                    child_key: str = "config_name", parent_key: str = "name", created: str = "created_at") -> DataFrame:
    """A reference state with a batch of new child and parent rows added."""
    parts = [x for x in (before,) if x is not None]
    if children is not None:
        parts.append(reference_deltas(children, child_key, created))
    if parents is not None:
        parts.append(existence_deltas(parents, parent_key, created))
    return fold(*parts)
