"""Queries that write: collections filled from the tables, changed, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.service import Service
from paperlake.session import checkpoint_dir, cut, table
from paperlake.sources.store import Catalog, Collection, DuplicateKey

_OWN = ("_id", "created_at", "updated_at")


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def _filled(catalog: Catalog, data: str, name: str) -> Collection:
    """A collection with every distinct row of a table, under new ids."""
    collection = catalog.collection(name)
    collection.create_many(table(catalog.spark, data, name).distinct().drop(*_OWN))
    return collection


def _configs(spark: SparkSession, data: str) -> list[dict]:
    """The configurations by name; their table does not grow."""
    rows = table(spark, data, "crawler_configs").distinct().drop(*_OWN).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["name"])


def q_store_create(spark: SparkSession, data: str) -> DataFrame:
    """Rows as they are stored, with new ids and one time for both stamps."""
    rows = _filled(_catalog(spark), data, "crawler_jobs").rows()
    return rows.groupBy("config_name", "status").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("_id").alias("n_ids"),
        F.count_distinct("_seq").alias("n_places"),
        F.count_if(F.col("created_at") == F.col("updated_at")).alias("n_stamped"),
    )


def q_store_create_responses(spark: SparkSession, data: str) -> DataFrame:
    """What inserts answer: a list, nothing, and a name that is taken."""
    configs = _catalog(spark).collection("crawler_configs")
    rows = _configs(spark, data)
    made, none = configs.create_many(rows), configs.create_many([])
    try:
        configs.create_one(rows[0])
        taken = "created"
    except DuplicateKey as e:
        taken = str(e)
    out = [
        ("list", made.success, made.created_count, len(set(made.ids))),
        ("nothing", none.success, none.created_count, len(none.ids)),
        (f"taken: {taken}", False, configs.count_documents(), 0),
    ]
    return spark.createDataFrame(out, "call string, success boolean, n long, n_ids int")


def q_store_by_id(spark: SparkSession, data: str) -> DataFrame:
    """Reads, an update and a delete by id, of the configurations first and last by name."""
    configs = _catalog(spark).collection("crawler_configs")
    ids = configs.create_many(_configs(spark, data)).ids
    first, last = ids[0], ids[-1]
    before = configs.get_by_id(first)
    update, again = configs.update_by_id(first, {"rate_limit": 77, "output_dir": None}), configs.update_by_id("0" * 24, {"rate_limit": 1})
    after, deleted = configs.get_by_id(first), configs.delete_by_id(last)
    out = [
        ("read", before["name"], before["rate_limit"], 1),
        ("updated", after["name"], after["rate_limit"], update.modified_count),
        ("missing", None, None, again.matched_count),
        ("deleted", configs.get_by_id(last) and "still there", None, deleted.deleted_count),
        ("left", None, None, configs.count_documents()),
    ]
    return spark.createDataFrame(out, "call string, name string, rate_limit int, n long")


def q_store_update(spark: SparkSession, data: str) -> DataFrame:
    """The collection after an update of many rows and a merge."""
    jobs = _filled(_catalog(spark), data, "crawler_jobs")
    jobs.update_many({"status": "running"}, status="failed", error_message="stopped")
    jobs.merge(jobs.rows().where(F.col("max_papers") > 50).select("_id", F.lit(50).alias("max_papers")))
    return jobs.rows().groupBy("status", "error_message", "max_papers").agg(F.count(F.lit(1)).alias("n_rows"))


def q_store_update_responses(spark: SparkSession, data: str) -> DataFrame:
    """What updates answer: rows changed, rows whose time alone changes, no row, no field."""
    jobs = _filled(_catalog(spark), data, "crawler_jobs")
    calls = {
        "changed": jobs.update_many({"status": "completed"}, error_message="seen"),
        "again": jobs.update_many({"error_message": "seen"}, {"status": "completed"}),
        "none": jobs.update_many({"status": "no such status"}, error_message="x"),
        "empty": jobs.update_many({"status": "completed"}),
    }
    return spark.createDataFrame([(k, u.matched_count, u.message) for k, u in calls.items()], "call string, matched_count long, message string")


def q_store_delete(spark: SparkSession, data: str) -> DataFrame:
    """The collection after deletes, with what they answered."""
    jobs = _filled(_catalog(spark), data, "crawler_jobs")
    many, one = jobs.delete_many({"max_papers": {"$lt": 50}}), jobs.delete_one({"status": "completed"})
    none = jobs.delete_many({"status": "no such status"})
    counts = spark.createDataFrame(
        [("many", many.deleted_count, many.message), ("one", one.deleted_count, one.message), ("none", none.deleted_count, none.message)],
        "status string, n_rows long, message string",
    )
    left = jobs.rows().groupBy("status").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("message", F.lit("left"))
    return counts.unionByName(left)


def q_service_run(spark: SparkSession, data: str) -> DataFrame:
    """States and messages of the fresh jobs after a run without pages; the others stay as they are."""
    catalog = _catalog(spark)
    _filled(catalog, data, "crawler_configs")
    jobs = _filled(catalog, data, "crawler_jobs")
    fresh = cut(jobs.rows().where(F.col("status").isNull()).select("_id", F.lit(True).alias("fresh")))
    Service(catalog).run_jobs(spark.createDataFrame([], "url string, html string"))
    ran = jobs.rows().join(fresh, "_id", "left").na.fill(False, ["fresh"])
    return ran.groupBy("fresh", "status", "error_message").agg(F.count(F.lit(1)).alias("n_jobs"))


QUERIES = {
    f.__name__: f
    for f in (q_store_create, q_store_create_responses, q_store_by_id, q_store_update, q_store_update_responses, q_store_delete, q_service_run)
}

_ROWS = "WITH j AS (SELECT DISTINCT * FROM crawler_jobs), c AS (SELECT DISTINCT * FROM crawler_configs)"

SQL = {
    "q_store_create": f"""{_ROWS} SELECT config_name, status, count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_places, count(*) AS n_stamped
      FROM j GROUP BY config_name, status""",
    "q_store_create_responses": f"""{_ROWS}
      SELECT 'list' AS call, true AS success, count(*) AS n, CAST(count(*) AS INT) AS n_ids FROM c
      UNION ALL SELECT 'nothing', false, 0, 0 UNION ALL SELECT 'taken: name', false, count(*), 0 FROM c""",
    "q_store_by_id": f"""{_ROWS}, f AS (SELECT name, rate_limit FROM c ORDER BY name LIMIT 1)
      SELECT 'read' AS call, name, rate_limit, CAST(1 AS BIGINT) AS n FROM f
      UNION ALL SELECT 'updated', name, 77, 1 FROM f
      UNION ALL SELECT 'missing', NULL, NULL, 0 UNION ALL SELECT 'deleted', NULL, NULL, 1
      UNION ALL SELECT 'left', NULL, NULL, count(*) - 1 FROM c""",
    "q_store_update": f"""{_ROWS}
      SELECT status, error_message, max_papers, count(*) AS n_rows FROM (
        SELECT CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status,
               CASE WHEN status = 'running' THEN 'stopped' ELSE error_message END AS error_message,
               CASE WHEN max_papers > 50 THEN 50 ELSE max_papers END AS max_papers FROM j) GROUP BY ALL""",
    "q_store_update_responses": f"""{_ROWS}
      SELECT 'changed' AS call, count(*) AS matched_count, 'Documents updated successfully' AS message FROM j WHERE status = 'completed'
      UNION ALL SELECT 'again', count(*), 'Documents updated successfully' FROM j WHERE status = 'completed'
      UNION ALL SELECT 'none', 0, 'Documents not found for update' UNION ALL SELECT 'empty', 0, 'No fields to update'""",
    "q_store_delete": f"""{_ROWS}, l AS (SELECT * FROM j WHERE NOT coalesce(max_papers < 50, false))
      SELECT 'many' AS status, count(*) AS n_rows, 'Documents deleted successfully' AS message FROM j WHERE max_papers < 50
      UNION ALL SELECT 'one', 1, 'Document deleted successfully' UNION ALL SELECT 'none', 0, 'Documents not found for deletion'
      UNION ALL SELECT status, count(*) - CASE WHEN status = 'completed' THEN 1 ELSE 0 END, 'left' FROM l GROUP BY status""",
    "q_service_run": f"""{_ROWS}, r AS (
      SELECT j.status IS NULL AS fresh, j.status, j.error_message,
             CASE WHEN c.name IS NULL THEN concat('Configuration ''', coalesce(j.config_name, 'None'), ''' not found')
                  WHEN coalesce(c.source, '') <> 'acl_anthology' THEN concat('Crawler source ''', coalesce(c.source, 'None'), ''' not implemented')
             END AS error
      FROM j LEFT JOIN c ON j.config_name = c.name)
      SELECT fresh, CASE WHEN NOT fresh THEN status WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,
             CASE WHEN fresh THEN error ELSE error_message END AS error_message, count(*) AS n_jobs FROM r GROUP BY ALL""",
}
