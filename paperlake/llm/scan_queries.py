"""Queries p6_...: contents of scanned pages as continuous text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.inputs import spread
from paperlake.llm.scans import repaired_text, repairs
from paperlake.session import table


def pages(spark: SparkSession, data: str) -> DataFrame:
    """All contents with the title and authors of their paper."""
    contents = (
        table(spark, data, "papers")
        .select("_id", "title", "authors", F.explode("sections").alias("section_key", "section"))
        .select(F.col("_id").alias("paper_id"), "section_key", F.col("section")["content"].alias("content"), "title", "authors")
    )
    return spread(contents, "paper_id")


def p6_found(spark: SparkSession, data: str) -> DataFrame:
    return repairs(pages(spark, data)).select("paper_id", "section_key", "line_no", "repair").distinct()


def p6_repaired_text(spark: SparkSession, data: str) -> DataFrame:
    contents = pages(spark, data)
    return repaired_text(contents, repairs(contents))


QUERIES = {"p6_found": p6_found, "p6_repaired_text": p6_repaired_text}
SQL: dict[str, str] = {}
