"""Stored schemas, creation defaults and bounds of the three collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = "_id string, created_at timestamp_ntz, updated_at timestamp_ntz"

CRAWLER_CONFIGS = (
    f"{_BASE}, name string, source string, rate_limit int, max_delay int, max_attempts int, max_concurrent int, output_dir string"
)
CRAWLER_JOBS = (
    f"{_BASE}, config_name string, query string, urls array<string>, max_papers int, started_at timestamp_ntz,"
    " completed_at timestamp_ntz, error_message string, status string"
)
PAPERS = (
    f"{_BASE}, title string, authors array<string>, source string, source_id string, year int, url string, pdf_url string,"
    " local_pdf_path string, venues array<string>,"
    " sections map<string, struct<title: string, content: string, level: int>>, job_id string"
)
COLLECTIONS = {"crawler_configs": CRAWLER_CONFIGS, "crawler_jobs": CRAWLER_JOBS, "papers": PAPERS}
#: Fields that must be unique in a collection.
UNIQUE = {"crawler_configs": ("name",)}

# Enumerations, defaults of missing fields, lower bounds.
SOURCES = ("acl_anthology",)
STATUSES = ("pending", "running", "completed", "failed")
DEFAULTS = {
    "crawler_configs": {"rate_limit": 10, "max_delay": 60, "max_attempts": 3, "max_concurrent": 10, "output_dir": "crawled_papers"},
    "crawler_jobs": {"status": "pending"},
    "papers": {},
}
BOUNDS = {
    "crawler_configs": {"rate_limit": 1, "max_delay": 1, "max_attempts": 1, "max_concurrent": 1},
    "crawler_jobs": {"max_papers": 0},
    "papers": {},
}


def with_defaults(collection: str, columns: list[str]) -> list[Column]:
    """The columns as they are read: a field that was never stored has its default."""
    defaults = DEFAULTS[collection]
    return [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in columns]


def violations(collection: str) -> dict[str, Column]:
    """Per field, whether a stored value breaks its bound or enumeration; null values break none."""
    out = {f: F.coalesce(F.col(f) < F.lit(low), F.lit(False)) for f, low in BOUNDS[collection].items()}
    if collection in ("crawler_configs", "papers"):
        out["source"] = F.coalesce(~F.col("source").isin(*SOURCES), F.lit(False))
    if collection == "crawler_jobs":
        out["status"] = F.coalesce(~F.col("status").isin(*STATUSES), F.lit(False))
        out["urls"] = F.exists(
            F.coalesce("urls", F.array().cast("array<string>")), lambda u: ~F.coalesce(u.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))
        )
    return out


def fail_on_violation(collection: str) -> Column:
    """True for a valid row; raises on the first row that is not, so one bad row fails the whole read."""
    bad = None
    for c in violations(collection).values():
        bad = c if bad is None else bad | c
    return F.lit(True) if bad is None else F.when(bad, F.raise_error(F.lit(f"invalid row in {collection}"))).otherwise(F.lit(True)).cast("boolean")
