"""Queries p4_...: contents as sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm.inputs import sections
from paperlake.llm.sentences import learn, sentences


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    models = learn(sections(spark, data))
    return sentences(sections(spark, data, "abstract"), models, ("paper_id",)).select("paper_id", "end_char").distinct()


def p4_sentences(spark: SparkSession, data: str) -> DataFrame:
    """The sentences of all contents with their places."""
    contents = sections(spark, data)
    return sentences(contents, learn(contents), ("paper_id", "section_key")).distinct()


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences}
SQL: dict[str, str] = {}
