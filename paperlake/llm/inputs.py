"""Views of the project's tables that several operators start from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperlake.session import table


def map_lists(df: DataFrame, rows: Callable[..., Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """Pass whole Arrow batches to `rows` as one Python list per column; it returns output tuples.

    Strings cross as Arrow buffers, so there is no per-row pickling; a batch
    bounds what a task holds at once.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(rows(*(column.to_pylist() for column in batch.columns)))
            if found:
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(arrow, columns)], schema=arrow)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the scan gave less than half of them a task, as with one small file.

    A scan in more pieces is left alone, so nothing large is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(key)) if 2 * df.rdd.getNumPartitions() <= cores else df


def documents(spark: SparkSession, data: str) -> DataFrame:
    """(doc_id, text) of all documents."""
    return spread(table(spark, data, "documents").select("doc_id", "text"), "doc_id")


def sections(spark: SparkSession, data: str, *keys: str) -> DataFrame:
    """(paper_id, section_key, content) of every non-empty content, of the given keys or of all."""
    papers = table(spark, data, "papers")
    if keys:
        one = [
            papers.select("_id", F.lit(key).alias("section_key"), F.col("sections")[key]["content"].alias("content"))
            for key in keys
        ]
        out = one[0]
        for x in one[1:]:
            out = out.unionByName(x)
    else:
        out = papers.select("_id", F.explode("sections").alias("section_key", "section")).select(
            "_id", "section_key", F.col("section")["content"].alias("content")
        )
    return spread(out.where(F.length("content") > 0).withColumnRenamed("_id", "paper_id"), "paper_id")
