"""From jobs and stored pages to papers: the crawl as one plan.

Seeds are routed by their address, event pages are read once per job whatever
part is asked for, listed papers become candidates, the crawl plan decides
which of them are fetched within each job's budget, and the pages of those
become rows of papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions import html as H
from paperlake.functions import urls as U
from paperlake.operators.crawl import first_visits, plan
from paperlake.operators.sections import WANTED, normalize, section_map
from paperlake.schemas import DEFAULTS

#: Where papers are stored whose job names no folder.
FOLDER = DEFAULTS["crawler_configs"]["output_dir"]


def seeds(jobs: DataFrame, base: str) -> DataFrame:
    """(job_id, seed_no, url, kind, page, part): a job's addresses in order, then its search.

    page is what an event page is fetched as, null for other kinds; part is
    what follows # there, null if empty.
    """
    urls = jobs.select("job_id", F.posexplode("urls").alias("seed_no", "url"))
    searches = jobs.where(F.length("query") > 0).select(
        "job_id", F.coalesce(F.size("urls"), F.lit(0)).alias("seed_no"), U.search_url(base, F.col("query")).alias("url")
    )
    every = urls.unionByName(searches).where(F.col("url").isNotNull()).withColumn("kind", U.route(F.col("url")))
    event = F.col("kind") == "conference"
    return every.select(
        "job_id", "seed_no", "url", "kind",
        F.when(event, U.base_url(F.col("url"))).alias("page"),
        F.when(event, F.nullif(U.fragment(F.col("url")), F.lit(""))).alias("part"),
    )


def candidates(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """(job_id, seed_no, place, id) of the papers that the seeds lead to."""
    direct = planned.where(F.col("kind") == "paper").select("job_id", "seed_no", F.lit(0).alias("place"), U.last_segment(F.col("url")).alias("id"))
    events = first_visits(planned.where(F.col("page").isNotNull()), "job_id", "page", order=("seed_no",))
    lists = events.unionByName(planned.where(F.col("kind") == "search")).withColumn("at", F.coalesce("page", "url"))
    # A list is parsed once for every part asked for, not once for every job.
    key = F.sha2(F.concat_ws("\u0000", "at", "kind", F.coalesce("part", F.lit(""))), 256)
    lists = lists.withColumn("page_id", key)
    asked = lists.select("page_id", "at", "kind", "part").distinct()
    ids = H.extract_ids(asked.join(pages.withColumnRenamed("url", "at"), "at"))
    listed = lists.select("job_id", "seed_no", "page_id").join(ids, "page_id").select("job_id", "seed_no", "place", "id")
    return direct.where(F.col("id").isNotNull()).unionByName(listed)


def harvest(jobs: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """Rows of papers that the jobs find.

    `jobs` has job_id, urls, query, max_papers and, if a job has a folder of its
    own, output_dir; `pages` url and html.  A page that isn't stored, or that
    can't be parsed, is a failed fetch.  Repeated jobs and pages count once.
    """
    folder = F.col("output_dir") if "output_dir" in jobs.columns else F.lit(None).cast("string")
    jobs = jobs.select("job_id", "urls", "query", "max_papers", F.coalesce(folder, F.lit(FOLDER)).alias("output_dir")).dropDuplicates(["job_id"])
    pages = pages.select("url", "html").where(F.length("html") > 0).dropDuplicates(["url"])
    wanted = candidates(seeds(jobs, base), pages)
    ids = wanted.select("id").distinct().withColumn("url", U.paper_url(base, F.col("id")))
    parsed = H.extract_papers(ids.join(pages, "url").select(F.col("id").alias("page_id"), "html"))
    fetched = wanted.join(parsed.select(F.col("page_id").alias("id"), F.lit(True).alias("ok")), "id", "left")
    found = plan(
        fetched.select("job_id", "seed_no", F.lit(None).cast("string").alias("page"), "place", "id", F.coalesce("ok", F.lit(False)).alias("ok")),
        jobs.select("job_id", "max_papers"),
    )
    return found.join(parsed.withColumnRenamed("page_id", "id"), "id").join(jobs.select("job_id", "output_dir"), "job_id").select(
        "title", "authors", F.lit("acl_anthology").alias("source"), F.col("id").alias("source_id"), "year",
        U.paper_url(base, F.col("id")).alias("url"), "pdf_url",
        U.pdf_path(F.col("output_dir"), F.col("id")).alias("local_pdf_path"), "venues", "job_id",
    )


def with_sections(papers: DataFrame, texts: DataFrame, wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """Papers with the wanted sections of their texts (local_pdf_path, text); none where there is no text.

    Of several texts of one path the first by code point counts.
    """
    found = texts.groupBy("local_pdf_path").agg(F.min("text").alias("text")).select("local_pdf_path", section_map(normalize(F.col("text")), wanted).alias("sections"))
    return papers.join(found, "local_pdf_path", "left")
