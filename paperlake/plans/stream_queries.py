"""Queries that run a stream to its end over the tables' files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import checkpoint_dir
from paperlake.streaming.intake import job_stream, take_in


def _jobs(spark: SparkSession, data: str) -> DataFrame:
    import os

    folder, name = f"{data}/crawler_jobs.parquet", "*.parquet"
    if os.path.isfile(folder):
        folder, name = data, "crawler_jobs.parquet"
    return job_stream(spark, folder, name_filter=name)


def q_stream_jobs(spark: SparkSession, data: str) -> DataFrame:
    """Jobs taken in by file, each batch appended with the state they start with."""
    place = f"{checkpoint_dir(spark)}/intake-{uuid.uuid4().hex}"

    def run(batch: DataFrame, number: int) -> None:
        state = F.coalesce("status", F.lit("pending"))
        # The number names the folder, so a batch that is given again replaces itself.
        batch.select("_id", "config_name", state.alias("state")).write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    take_in(_jobs(spark, data), run, f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/rows").select("_id", "config_name", "state").distinct()


QUERIES = {"q_stream_jobs": q_stream_jobs}
SQL = {"q_stream_jobs": "SELECT DISTINCT _id, config_name, coalesce(status, 'pending') AS state FROM crawler_jobs"}
