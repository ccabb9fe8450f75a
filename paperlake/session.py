"""Session settings and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "paperlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on; `conf` overrides them.

    UTC is fixed because stored timestamps carry no zone.  Adaptive execution
    sizes shuffle partitions at run time, so no partition count is set here.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # What was written only to cut a plan goes when nothing refers to it any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a local one only where that is unset and all tasks run in this process."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"paperlake-checkpoint-{os.getpid()}")
    context.setCheckpointDir(path)
    return context.getCheckpointDir() or path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there.

    Used where a result is read more than once or a loop grows the lineage; the
    files survive the loss of an executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, data: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{data}/{name}.parquet")
