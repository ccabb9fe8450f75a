"""Jobs: validity, the configuration they run with, and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.schemas import SOURCES


def has_work(query: Column, urls: Column) -> Column:
    """A job needs a query or an address."""
    return (F.length(F.coalesce(query, F.lit(""))) > 0) | (F.coalesce(F.size(urls), F.lit(0)) > 0)


def with_config(jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """Every job with its configuration's settings, nulls where there is none.

    Spark broadcasts the configurations if they are small and shuffles
    otherwise; names are unique, so no job is repeated.
    """
    c = configs.select(F.col("name").alias("config_name"), *(F.col(x) for x in ("source", "rate_limit", "max_delay", "max_attempts", "max_concurrent", "output_dir")))
    return jobs.join(c, "config_name", "left")


def runnable_state(found: Column, source: Column) -> Column:
    """State of a job that starts: failed without a configuration or with an unknown source, else running."""
    return F.when(found & source.isin(*SOURCES), "running").otherwise("failed")


def transition(state: Column, found: Column, source: Column, n_papers: Column, error: Column) -> Column:
    """Final state of a started job: an error fails it, none found or papers stored complete it."""
    started = runnable_state(found, source)
    return F.when(started == "failed", "failed").when(error.isNotNull(), "failed").when(n_papers.isNotNull(), "completed").otherwise(state)


def new_names(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of a batch whose name is neither stored nor earlier in the batch."""
    fresh = batch.join(existing.select("name").distinct(), "name", "left_anti")
    w = Window.partitionBy("name").orderBy(order)
    return fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
