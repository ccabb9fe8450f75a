"""Queries p1_...: spellings that name one author."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.names import name_groups, variant_pairs
from paperlake.session import table


def author_names(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "papers").select(F.explode("authors").alias("name")).where(F.col("name").isNotNull()).distinct()


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    return variant_pairs(name_groups(author_names(spark, data))).distinct()


def p1_groups(spark: SparkSession, data: str) -> DataFrame:
    """Every spelling with its group and the number of spellings in it."""
    groups = name_groups(author_names(spark, data))
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n_spellings"))
    return groups.join(sizes, "group").select("name", F.col("group").alias("name_group"), "n_spellings")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
