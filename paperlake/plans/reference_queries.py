"""Queries p3_...: references that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.references import broken_references, changed, existence_deltas, fold, orphan_keys, reference_deltas, reference_report
from paperlake.session import cut, table


def _all_broken(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    papers = broken_references(
        table(spark, data, "papers"), jobs, child_id="_id", child_key="job_id", parent_key="_id"
    ).withColumn("child_table", F.lit("papers"))
    configs = broken_references(
        jobs, table(spark, data, "crawler_configs"), child_id="_id", child_key="config_name", parent_key="name"
    ).withColumn("child_table", F.lit("crawler_jobs"))
    return papers.unionByName(configs)


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    return _all_broken(spark, data).select("child_table", "child_id", "ref_state").distinct()


def p3_report(spark: SparkSession, data: str) -> DataFrame:
    return reference_report(_all_broken(spark, data))


def p3_orphan_keys(spark: SparkSession, data: str) -> DataFrame:
    """Orphan keys of both references with the number of distinct rows that refer to them."""
    jobs = table(spark, data, "crawler_jobs").dropDuplicates(["_id"])
    papers = table(spark, data, "papers").select("_id", "job_id", "created_at").distinct()
    configs = table(spark, data, "crawler_configs")
    out = []
    for name, state in (
        ("papers", fold(reference_deltas(papers, "job_id", "created_at"), existence_deltas(jobs, "_id", "created_at"))),
        ("crawler_jobs", fold(reference_deltas(jobs, "config_name", "created_at"), existence_deltas(configs, "name", "created_at"))),
    ):
        out.append(orphan_keys(state).select(F.lit(name).alias("child_table"), "key", F.col("refs").alias("n_refs")))
    return out[0].unionByName(out[1])


def p3_maintained(spark: SparkSession, data: str) -> DataFrame:
    """Orphan keys of papers after a batch of changes: a stored state and the changes' deltas, not the tables again.

    Before the batch there are no completed jobs and no papers since 2015; it
    adds these, and deletes the failed jobs and the papers without a year.
    """
    jobs = table(spark, data, "crawler_jobs").select("_id", "created_at", "status")
    papers = table(spark, data, "papers").select("_id", "job_id", "created_at", "year")
    old_jobs, new_jobs = jobs.where(~F.col("status").eqNullSafe("completed")), jobs.where(~F.col("status").eqNullSafe("failed"))
    old_papers, new_papers = papers.where(F.coalesce(F.col("year") < 2015, F.lit(True))), papers.where(F.col("year").isNotNull())
    state = cut(
        fold(
            reference_deltas(old_papers.dropDuplicates(["_id"]), "job_id", "created_at"),
            existence_deltas(old_jobs.dropDuplicates(["_id"]), "_id", "created_at"),
        )
    )
    after = fold(
        state, changed(old_papers, new_papers, "_id", "job_id", "created_at", "child"), changed(old_jobs, new_jobs, "_id", "_id", "created_at", "parent")
    )
    return orphan_keys(after).select("key", F.col("refs").alias("n_refs"))


_BROKEN = """
WITH child AS (
  SELECT DISTINCT 'papers' AS child_table, _id AS child_id, job_id AS k, created_at FROM papers
  UNION ALL
  SELECT DISTINCT 'crawler_jobs', _id, config_name, created_at FROM crawler_jobs
), parent AS (
  SELECT 'papers' AS child_table, _id AS k, min(created_at) AS parent_at FROM crawler_jobs GROUP BY _id
  UNION ALL
  SELECT 'crawler_jobs', name, min(created_at) FROM crawler_configs GROUP BY name
), broken AS (
  SELECT c.child_table, c.child_id, c.created_at, c.k,
         CASE WHEN p.k IS NULL THEN 'missing' WHEN p.parent_at > c.created_at THEN 'late' END AS ref_state
  FROM child c LEFT JOIN parent p ON p.child_table = c.child_table AND p.k = c.k
  WHERE c.k IS NOT NULL AND regexp_replace(c.k, '\\s', '', 'g') <> ''
)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_orphan_keys": p3_orphan_keys, "p3_maintained": p3_maintained}

SQL = {
    "p3_found": _BROKEN + "SELECT DISTINCT child_table, child_id, ref_state FROM broken WHERE ref_state IS NOT NULL",
    "p3_report": _BROKEN
    + """SELECT child_table, strftime(created_at, '%Y-%m') AS month, ref_state,
         count(DISTINCT child_id) AS n_refs, count(DISTINCT k) AS n_keys
         FROM broken WHERE ref_state IS NOT NULL GROUP BY ALL""",
    "p3_orphan_keys": _BROKEN
    + """SELECT child_table, k AS key, count(DISTINCT child_id) AS n_refs
         FROM broken WHERE ref_state = 'missing' GROUP BY ALL""",
    "p3_maintained": """
      SELECT job_id AS key, count(DISTINCT _id) AS n_refs FROM papers
      WHERE year IS NOT NULL AND regexp_replace(job_id, '\\s', '', 'g') <> ''
        AND job_id NOT IN (SELECT _id FROM crawler_jobs WHERE status IS DISTINCT FROM 'failed') GROUP BY job_id""",
}
