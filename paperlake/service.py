"""The operations of the service, on a catalog: what each endpoint does, without a web server."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.harvest import harvest, with_sections
from paperlake.schemas import SOURCES
from paperlake.session import cut
from paperlake.sources.store import Catalog, Created, Deleted, DuplicateKey, Updated, _now
from paperlake.sources.web import to_download, write_pdfs


class NotFound(LookupError):
    """No row has the id or name (404)."""


class Conflict(ValueError):
    """The name is taken (409)."""


class BadRequest(ValueError):
    """The object is incomplete (400)."""


class Service:
    def __init__(self, catalog: Catalog, base: str = "https://anthology.example") -> None:
        self.catalog, self.base = catalog, base

    def _of(self, name: str):
        return self.catalog.collection(name)

    def list(self, collection: str, skip: int = 0, limit: int = 100, **equal: Any) -> DataFrame:
        """A page, latest first; arguments that are None don't filter."""
        query = {k: v for k, v in equal.items() if v is not None}
        return self._of(collection).get_many(query, skip, limit)

    def get(self, collection: str, id: str) -> dict[str, Any]:
        row = self._of(collection).get_by_id(id)
        if row is None:
            raise NotFound(id)
        return row

    def patch(self, collection: str, id: str, fields: dict[str, Any]) -> Updated:
        return self._of(collection).update_by_id(id, fields)

    def delete(self, collection: str, id: str) -> Deleted:
        """References to the row are left as they are."""
        return self._of(collection).delete_by_id(id)

    def config_by_name(self, name: str) -> dict[str, Any]:
        row = self._of("crawler_configs").get_one({"name": name})
        if row is None:
            raise NotFound(name)
        return row

    def create_config(self, config: dict[str, Any]) -> Created:
        try:
            return self._of("crawler_configs").create_one(config)
        except DuplicateKey as e:
            raise Conflict(config.get("name")) from e

    def create_paper(self, paper: dict[str, Any]) -> Created:
        return self._of("papers").create_one(paper)

    def create_job(self, job: dict[str, Any], pages: DataFrame | None = None, **run: Any) -> Created:
        """Store a job whose configuration exists; it has no status until it runs, which it does at once if there are pages."""
        if not job.get("query") and not job.get("urls"):
            raise BadRequest("a job needs a query or urls")
        self.config_by_name(job["config_name"])
        made = self._of("crawler_jobs").create_one(job)
        if pages is not None:
            self.run_jobs(pages, made.ids, **run)
        return made

    def run_jobs(
        self,
        pages: DataFrame,
        ids: list[str] | None = None,
        texts: DataFrame | None = None,
        fetch: Callable[[str], tuple[int, bytes]] | None = None,
    ) -> int:
        """Run jobs, by default all that have no status yet, over stored pages as one plan; returns the number of papers stored.

        Every job keeps its configuration's folder.  One without configuration,
        or with a source that isn't known, fails with a message.  If the plan
        fails, its jobs are run in two parts, and so on, until only those that
        fail by themselves are left; these keep the error's message.  `fetch`
        downloads the papers' PDF files that aren't there yet.
        """
        jobs, configs = self._of("crawler_jobs"), self._of("crawler_configs")
        rows = jobs.rows().where(F.col("status").isNull() if ids is None else F.col("_id").isin(ids)).select("_id", "config_name")
        known = configs.read().select(F.col("name").alias("config_name"), "source", F.lit(True).alias("found"))
        shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
        error = F.when(F.col("found").isNull(), F.format_string("Configuration '%s' not found", shown("config_name"))).when(
            ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), F.format_string("Crawler source '%s' not implemented", shown("source"))
        )
        begun = cut(rows.join(known, "config_name", "left").select("_id", error.alias("error_message")))
        now = F.lit(_now()).cast("timestamp_ntz")
        failed = F.col("error_message").isNotNull()
        jobs.merge(
            begun.select("_id", F.when(failed, "failed").otherwise("running").alias("status"), "error_message", F.when(~failed, now).alias("started_at"))
        )
        return self._run(pages, begun.where(~failed).select("_id"), texts, fetch)

    def _run(self, pages: DataFrame, ready: DataFrame, texts: DataFrame | None, fetch: Callable | None, depth: int = 0) -> int:
        jobs = self._of("crawler_jobs")
        n = ready.count()
        if not n:
            return 0
        try:
            folders = self._of("crawler_configs").read().select(F.col("name").alias("config_name"), "output_dir")
            started = jobs.rows().join(ready, "_id", "left_semi").withColumnRenamed("_id", "job_id").join(folders, "config_name")
            papers = harvest(started, pages, self.base)
            if texts is not None:
                papers = with_sections(papers, texts)
            papers = cut(papers)
            if fetch is not None:
                write_pdfs(to_download(papers), fetch)
            made = self._of("papers").create_many(papers)
        except Exception as e:
            if n == 1:
                jobs.merge(ready.select("_id", F.lit("failed").alias("status"), F.lit(str(e)[:500]).alias("error_message")))
                return 0
            half = F.shiftright(F.xxhash64("_id"), depth) % 2 == 0
            return self._run(pages, ready.where(half), texts, fetch, depth + 1) + self._run(pages, ready.where(~half), texts, fetch, depth + 1)
        jobs.merge(ready.select("_id", F.lit("completed").alias("status"), F.lit(_now()).cast("timestamp_ntz").alias("completed_at")))
        return made.created_count

    def health(self) -> dict[str, str]:
        return {"status": "healthy" if self.catalog.healthy() else "database_error"}

    @staticmethod
    def root() -> dict[str, str]:
        return {"message": "Research Agent API is running"}
