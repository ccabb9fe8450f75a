"""Small column functions: numbers, times, retry and page arithmetic, HTTP outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_year(text: Column) -> Column:
    """An integer, or null if the text is none."""
    return F.trim(text).try_cast("int")


def venues(text: Column) -> Column:
    """Parts between bars, untrimmed; an empty or null text has none."""
    return F.when(F.length(text) > 0, F.split(text, r"\|")).otherwise(F.array().cast("array<string>"))


def page_budget(max_papers: Column, per_page: int = 10, most: int = 10) -> Column:
    """Result pages to read for so many papers; null asks for the most."""
    return F.coalesce(F.least(F.floor((max_papers - 1) / per_page) + 1, F.lit(most)), F.lit(most)).cast("int")


def request_delay(rate_limit: Column) -> Column:
    """Seconds between requests at so many a minute."""
    return F.lit(60.0) / rate_limit


def backoff(rate_limit: Column, attempt: Column, max_delay: Column) -> Column:
    """Seconds to wait before a retry, without jitter."""
    return F.least(F.pow(F.lit(2.0), attempt) * request_delay(rate_limit), max_delay.cast("double"))


def backoff_bounds(wait: Column) -> tuple[Column, Column]:
    """Least and most seconds that the jitter makes of a wait."""
    return wait * 0.75, wait * 1.25


def http_outcome(code: Column) -> Column:
    """ok, retry or drop."""
    return F.when(code == 200, "ok").when((code == 429) | (code >= 500), "retry").when(code.isNotNull(), "drop")


def to_milliseconds(at: Column) -> Column:
    """A time without zone cut to milliseconds."""
    return F.date_trunc("MILLISECOND", at).cast("timestamp_ntz")


def new_id(*parts: Column) -> Column:
    """24 hexadecimal digits that follow from the parts."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *(p.cast("string") for p in parts)), 256), 1, 24)


def is_object_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))
