"""Filtered, sorted and paged reads, and what updates and deletes make of a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators.predicates import compile_filter


def newest_first(df: DataFrame, tie: str) -> DataFrame:
    """By updated_at, latest first, nulls last; `tie` orders equals."""
    return df.orderBy(F.desc_nulls_last("updated_at"), F.asc(tie))


def get_many(df: DataFrame, query: dict[str, Any] | None = None, skip: int = 0, limit: int = 100, tie: str = "_id") -> DataFrame:
    """One page.  It is sorted before it is cut; limit 0 means no limit, a negative limit counts as positive."""
    if skip < 0:
        raise ValueError("skip must not be negative")
    page = newest_first(df.where(compile_filter(query, df.schema)), tie)
    if skip:
        page = page.offset(skip)
    return page.limit(abs(limit)) if limit else page


def get_one(df: DataFrame, query: dict[str, Any] | None = None, natural: str = "_id") -> DataFrame:
    """The first match in natural order, as a table of at most one row."""
    return df.where(compile_filter(query, df.schema)).orderBy(natural).limit(1)


def first_match(df: DataFrame, query: dict[str, Any] | None, natural: str) -> DataFrame:
    """One row with the place of the first match, null without one."""
    return df.where(compile_filter(query, df.schema)).agg(F.min(natural).alias("_first"))


def updated(df: DataFrame, patch: dict[str, Any | Column], matches: Column) -> DataFrame:
    """The table after the present keys of a patch are set where `matches` holds; an explicit None writes null."""
    types = dict(df.dtypes)
    set_to = {k: v if isinstance(v, Column) else F.lit(v) for k, v in patch.items()}
    return df.withColumns({k: F.when(matches, v.cast(types[k])).otherwise(F.col(k)) for k, v in set_to.items()})


def update_counts(df: DataFrame, patch: dict[str, Any | Column], matches: Column) -> DataFrame:
    """(matched_count, modified_count) of an update; rows that already hold all values are not modified."""
    types = dict(df.dtypes)
    changes = F.lit(False)
    for k, v in patch.items():
        changes = changes | ~F.col(k).eqNullSafe((v if isinstance(v, Column) else F.lit(v)).cast(types[k]))
    return df.agg(
        F.count_if(matches).alias("matched_count"), F.count_if(matches & changes).alias("modified_count")
    )


def update_response(counts: DataFrame) -> DataFrame:
    """counts with success and message."""
    matched, modified = F.col("matched_count"), F.col("modified_count")
    return counts.select(
        (modified > 0).alias("success"),
        "matched_count",
        "modified_count",
        F.when(matched == 0, "Documents not found for update")
        .when(modified == 0, "Documents found but no changes made")
        .otherwise("Documents updated successfully")
        .alias("message"),
    )


def deleted(df: DataFrame, matches: Column) -> DataFrame:
    """The rows that stay; a predicate that is null matches nothing."""
    return df.where(~F.coalesce(matches, F.lit(False)))


def delete_response(df: DataFrame, matches: Column) -> DataFrame:
    n = df.agg(F.count_if(F.coalesce(matches, F.lit(False))).alias("deleted_count"))
    return n.select(
        (F.col("deleted_count") > 0).alias("success"),
        "deleted_count",
        F.when(F.col("deleted_count") > 0, "Documents deleted successfully").otherwise("Documents not found for deletion").alias("message"),
    )
