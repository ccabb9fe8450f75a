"""Papers as a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators.sections import WANTED, normalize, section_map


def page_text(pages: Column) -> Column:
    """Texts of pages in order, each with a line end, as one text."""
    return F.aggregate(pages, F.lit(""), lambda text, page: F.concat(text, page, F.lit("\n")))


def synthesised_text(stored: Column) -> Column:
    """The text a paper with these stored sections was read from: every section under a numbered heading."""
    keys = F.filter(F.array(*map(F.lit, WANTED)), lambda k: F.coalesce(F.map_contains_key(stored, k), F.lit(False)))
    return F.array_join(
        F.transform(
            keys,
            lambda k, i: F.concat(
                (i + 1).cast("string"), F.lit(" "), stored[k]["title"], F.lit("\n"), F.coalesce(stored[k]["content"], F.lit(""))
            ),
        ),
        "\n",
    )


def flat(found: Column) -> list[Column]:
    """Content of the wanted sections as columns, null where a section is missing."""
    return [found[k]["content"].alias(k) for k in WANTED]


def read_model(papers: DataFrame, text: Column) -> DataFrame:
    """One row per paper with the contents of its wanted sections, found in its text."""
    found = papers.withColumn("_found", section_map(normalize(text), WANTED))
    return found.select("_id", "title", "authors", "year", "url", *flat(F.col("_found")))
