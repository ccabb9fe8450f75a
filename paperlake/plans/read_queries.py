"""Queries on reads, filters, defaults, updates, deletes and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.scalars import backoff, http_outcome, page_budget, to_milliseconds
from paperlake.operators import jobs as J
from paperlake.operators.predicates import compile_filter
from paperlake.operators.reads import delete_response, deleted, first_match, get_many, get_one, update_counts, update_response, updated
from paperlake.schemas import violations, with_defaults
from paperlake.session import table

JOB = ["_id", "config_name", "status", "max_papers", "updated_at"]


def q_get_many_page(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs").dropDuplicates(["_id"])
    return get_many(jobs, {"status": "failed"}, skip=5, limit=10).select(*JOB)


def q_get_many_limit0(spark: SparkSession, data: str) -> DataFrame:
    return get_many(table(spark, data, "crawler_jobs"), {"status": "completed"}, limit=0).select(*JOB)


def q_get_by_id(spark: SparkSession, data: str) -> DataFrame:
    configs = table(spark, data, "crawler_configs")
    newest = configs.agg(F.max("_id").alias("_id"))
    return configs.join(newest, "_id", "left_semi").select("_id", "name", "source")


def q_get_one_by_name(spark: SparkSession, data: str) -> DataFrame:
    return get_one(table(spark, data, "crawler_configs"), {"name": "velt-search"}).select("_id", "name", "rate_limit")


def q_get_one_missing(spark: SparkSession, data: str) -> DataFrame:
    return get_one(table(spark, data, "crawler_configs"), {"name": "no such name"}).select("_id", "name")


def q_optional_filter(spark: SparkSession, data: str) -> DataFrame:
    """A status selects on what is stored, so fresh jobs without one aren't pending; no status selects all."""
    jobs = table(spark, data, "crawler_jobs")
    out = None
    for given in ("pending", None):
        query = {} if given is None else {"status": given}
        part = jobs.where(compile_filter(query, jobs.schema)).agg(F.count(F.lit(1)).alias("n")).withColumn("given", F.lit(given).cast("string"))
        out = part if out is None else out.unionByName(part)
    shown = jobs.select(*with_defaults("crawler_jobs", jobs.columns)).where(F.col("status") == "pending")
    return out.unionByName(shown.agg(F.count(F.lit(1)).alias("n")).withColumn("given", F.lit("pending as read")))


def q_filter_operators(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    query = {
        "$or": [{"status": {"$in": ["failed", "running"]}}, {"query": None, "max_papers": {"$gte": 50}}],
        "config_name": {"$ne": "velt-search"},
        "completed_at": {"$exists": False},
    }
    return jobs.where(compile_filter(query, jobs.schema)).select("_id", "status", "max_papers").distinct()


def q_array_contains(spark: SparkSession, data: str) -> DataFrame:
    papers = table(spark, data, "papers")
    return papers.where(compile_filter({"venues": "WS", "year": {"$gt": 2015}}, papers.schema)).select("_id", "year").distinct()


def q_schema_defaults(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    return jobs.select(*with_defaults("crawler_jobs", jobs.columns)).select("_id", "status").distinct()


def q_json_field(spark: SparkSession, data: str) -> DataFrame:
    events = table(spark, data, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def q_json_rows(spark: SparkSession, data: str) -> DataFrame:
    """Rows as the service answers them."""
    jobs = table(spark, data, "crawler_jobs")
    shown = F.to_json(F.struct("_id", "config_name", "max_papers"), {"ignoreNullFields": "false"})
    return jobs.select(shown.alias("body")).distinct()


def q_sparse_patch(spark: SparkSession, data: str) -> DataFrame:
    """Present keys are set, an explicit null too; all others stay."""
    configs = table(spark, data, "crawler_configs")
    matches = compile_filter({"source": "acl_anthology"}, configs.schema)
    return updated(configs, {"rate_limit": 7, "output_dir": None}, matches).select("_id", "name", "rate_limit", "max_delay", "output_dir")


def q_insert_response(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    batch = jobs.where(F.col("status") == "failed").select("_id").distinct()
    return batch.agg((F.count(F.lit(1)) > 0).alias("success"), F.count(F.lit(1)).alias("created_count"))


def _busy(df: DataFrame):
    return compile_filter({"status": "running"}, df.schema)


def q_update_many_image(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    return updated(jobs, {"status": "failed", "error_message": "stopped"}, _busy(jobs)).select("_id", "status", "error_message").distinct()


def q_update_response(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    return update_response(update_counts(jobs, {"max_papers": 50}, compile_filter({"status": "completed"}, jobs.schema)))


def q_update_one_first(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs").dropDuplicates(["_id"])
    first = first_match(jobs, {"status": "failed"}, "_id")
    joined = jobs.join(F.broadcast(first))
    return updated(joined, {"status": "pending"}, F.col("_id") == F.col("_first")).select("_id", "status")


def q_delete_many_image(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    return deleted(jobs, F.col("max_papers") < 50).select("_id", "max_papers").distinct()


def q_delete_one_first(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs").dropDuplicates(["_id"])
    joined = jobs.join(F.broadcast(first_match(jobs, {"status": "failed"}, "_id")))
    return deleted(joined, F.col("_id") == F.col("_first")).select("_id", "status")


def q_delete_response(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs")
    return delete_response(jobs, F.col("max_papers") < 50)


def q_job_config_join(spark: SparkSession, data: str) -> DataFrame:
    joined = J.with_config(table(spark, data, "crawler_jobs"), table(spark, data, "crawler_configs"))
    state = J.runnable_state(F.col("source").isNotNull(), F.col("source"))
    return joined.select("_id", "config_name", "rate_limit", state.alias("state")).distinct()


def q_config_exists_semi(spark: SparkSession, data: str) -> DataFrame:
    configs = table(spark, data, "crawler_configs").select(F.col("name").alias("config_name"))
    return table(spark, data, "crawler_jobs").join(configs, "config_name", "left_semi").select("_id", "config_name").distinct()


def q_orphan_jobs_anti(spark: SparkSession, data: str) -> DataFrame:
    configs = table(spark, data, "crawler_configs").select(F.col("name").alias("config_name"))
    return table(spark, data, "crawler_jobs").join(configs, "config_name", "left_anti").select("_id", "config_name").distinct()


def q_paper_job_join(spark: SparkSession, data: str) -> DataFrame:
    """Papers per configuration, through their jobs; counted per job before the join, as one job may hold very many."""
    per_job = table(spark, data, "papers").select("_id", "job_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    jobs = table(spark, data, "crawler_jobs").select(F.col("_id").alias("job_id"), "config_name").distinct()
    return per_job.join(jobs, "job_id").groupBy("config_name").agg(F.sum("n").alias("n_papers"))


def q_unique_insert(spark: SparkSession, data: str) -> DataFrame:
    batch = table(spark, data, "crawler_jobs").where(F.col("config_name").isNotNull()).select(F.col("config_name").alias("name"), "_id")
    return J.new_names(table(spark, data, "crawler_configs"), batch.distinct(), "_id").select("name", "_id")


def q_job_transition(spark: SparkSession, data: str) -> DataFrame:
    joined = J.with_config(table(spark, data, "crawler_jobs"), table(spark, data, "crawler_configs"))
    state = J.transition(F.col("status"), F.col("source").isNotNull(), F.col("source"), F.col("max_papers"), F.col("error_message"))
    return joined.select("_id", state.alias("state")).distinct()


def q_validate_job(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "crawler_jobs").select("_id", J.has_work(F.col("query"), F.col("urls")).alias("ok")).distinct()


def q_validation_counts(spark: SparkSession, data: str) -> DataFrame:
    configs = table(spark, data, "crawler_configs")
    return configs.agg(*(F.count_if(v).alias(f"bad_{k}") for k, v in violations("crawler_configs").items()))


def q_http_outcome(spark: SparkSession, data: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 301, 404, 429, 500, 503))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, data, "events").select("event_id", http_outcome(code).alias("outcome"))


def q_page_budget(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "crawler_jobs").select("_id", page_budget(F.nullif("max_papers", F.lit(0))).alias("pages")).distinct()


def q_backoff(spark: SparkSession, data: str) -> DataFrame:
    configs = table(spark, data, "crawler_configs").where((F.col("rate_limit") > 0) & (F.col("max_delay") > 0))
    return configs.select("_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt"), "rate_limit", "max_delay").select(
        "_id", "attempt", F.round(backoff(F.col("rate_limit"), F.col("attempt"), F.col("max_delay")), 6).alias("seconds")
    )


def q_trunc_ms(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "events").select("event_id", to_milliseconds(F.col("ts")).alias("ts_ms"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

SQL = {
    "q_get_many_page": """SELECT DISTINCT _id, config_name, status, max_papers, updated_at FROM crawler_jobs WHERE status = 'failed'
        ORDER BY updated_at DESC NULLS LAST, _id LIMIT 10 OFFSET 5""",
    "q_get_many_limit0": "SELECT _id, config_name, status, max_papers, updated_at FROM crawler_jobs WHERE status = 'completed'",
    "q_get_by_id": "SELECT _id, name, source FROM crawler_configs WHERE _id = (SELECT max(_id) FROM crawler_configs)",
    "q_get_one_by_name": "SELECT _id, name, rate_limit FROM crawler_configs WHERE name = 'velt-search' ORDER BY _id LIMIT 1",
    "q_get_one_missing": "SELECT _id, name FROM crawler_configs WHERE name = 'no such name'",
    "q_optional_filter": """SELECT 'pending' AS given, count(*) AS n FROM crawler_jobs WHERE status = 'pending'
        UNION ALL SELECT NULL, count(*) FROM crawler_jobs
        UNION ALL SELECT 'pending as read', count(*) FROM crawler_jobs WHERE status = 'pending' OR status IS NULL""",
    "q_filter_operators": """SELECT DISTINCT _id, status, max_papers FROM crawler_jobs
        WHERE (coalesce(status IN ('failed', 'running'), false) OR (query IS NULL AND coalesce(max_papers >= 50, false)))
        AND config_name IS DISTINCT FROM 'velt-search' AND completed_at IS NULL""",
    "q_array_contains": "SELECT DISTINCT _id, year FROM papers WHERE list_contains(venues, 'WS') AND year > 2015",
    "q_schema_defaults": "SELECT DISTINCT _id, coalesce(status, 'pending') AS status FROM crawler_jobs",
    "q_json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
    "q_json_rows": """SELECT DISTINCT '{"_id":' || to_json(_id) || ',"config_name":' || coalesce(to_json(config_name), 'null')
        || ',"max_papers":' || coalesce(CAST(max_papers AS VARCHAR), 'null') || '}' AS body FROM crawler_jobs""",
    "q_sparse_patch": """SELECT _id, name, CASE WHEN source = 'acl_anthology' THEN 7 ELSE rate_limit END AS rate_limit, max_delay,
        CASE WHEN source = 'acl_anthology' THEN NULL ELSE output_dir END AS output_dir FROM crawler_configs""",
    "q_insert_response": """SELECT count(*) > 0 AS success, count(*) AS created_count
        FROM (SELECT DISTINCT _id FROM crawler_jobs WHERE status = 'failed')""",
    "q_update_many_image": """SELECT DISTINCT _id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status,
        CASE WHEN status = 'running' THEN 'stopped' ELSE error_message END AS error_message FROM crawler_jobs""",
    "q_update_response": """SELECT m > 0 AS success, n AS matched_count, m AS modified_count,
        CASE WHEN n = 0 THEN 'Documents not found for update' WHEN m = 0 THEN 'Documents found but no changes made'
        ELSE 'Documents updated successfully' END AS message
        FROM (SELECT count(*) FILTER (WHERE status = 'completed') AS n,
        count(*) FILTER (WHERE status = 'completed' AND max_papers IS DISTINCT FROM 50) AS m FROM crawler_jobs)""",
    "q_update_one_first": """SELECT DISTINCT _id, CASE WHEN _id = (SELECT min(_id) FROM crawler_jobs WHERE status = 'failed')
        THEN 'pending' ELSE status END AS status FROM crawler_jobs""",
    "q_delete_many_image": "SELECT DISTINCT _id, max_papers FROM crawler_jobs WHERE NOT coalesce(max_papers < 50, false)",
    "q_delete_one_first": """SELECT DISTINCT _id, status FROM crawler_jobs
        WHERE _id IS DISTINCT FROM (SELECT min(_id) FROM crawler_jobs WHERE status = 'failed')""",
    "q_delete_response": """SELECT n > 0 AS success, n AS deleted_count,
        CASE WHEN n > 0 THEN 'Documents deleted successfully' ELSE 'Documents not found for deletion' END AS message
        FROM (SELECT count(*) AS n FROM crawler_jobs WHERE max_papers < 50)""",
    "q_job_config_join": """SELECT DISTINCT j._id, j.config_name, c.rate_limit,
        CASE WHEN c.source = 'acl_anthology' THEN 'running' ELSE 'failed' END AS state
        FROM crawler_jobs j LEFT JOIN crawler_configs c ON c.name = j.config_name""",
    "q_config_exists_semi": "SELECT DISTINCT _id, config_name FROM crawler_jobs WHERE config_name IN (SELECT name FROM crawler_configs)",
    "q_orphan_jobs_anti": """SELECT DISTINCT _id, config_name FROM crawler_jobs j
        WHERE NOT EXISTS (SELECT 1 FROM crawler_configs c WHERE c.name = j.config_name)""",
    "q_paper_job_join": """SELECT j.config_name, count(*) AS n_papers FROM (SELECT DISTINCT _id, job_id FROM papers) p
        JOIN (SELECT DISTINCT _id, config_name FROM crawler_jobs) j ON j._id = p.job_id GROUP BY 1""",
    "q_unique_insert": """SELECT config_name AS name, min(_id) AS _id FROM crawler_jobs
        WHERE config_name IS NOT NULL AND config_name NOT IN (SELECT name FROM crawler_configs) GROUP BY 1""",
    "q_job_transition": """SELECT DISTINCT j._id, CASE WHEN c.source IS DISTINCT FROM 'acl_anthology' OR j.error_message IS NOT NULL
        THEN 'failed' WHEN j.max_papers IS NOT NULL THEN 'completed' ELSE j.status END AS state
        FROM crawler_jobs j LEFT JOIN crawler_configs c ON c.name = j.config_name""",
    "q_validate_job": """SELECT DISTINCT _id, coalesce(query, '') <> '' OR coalesce(len(urls), 0) > 0 AS ok FROM crawler_jobs""",
    "q_validation_counts": """SELECT count(*) FILTER (WHERE rate_limit < 1) AS bad_rate_limit, count(*) FILTER (WHERE max_delay < 1) AS bad_max_delay,
        count(*) FILTER (WHERE max_attempts < 1) AS bad_max_attempts, count(*) FILTER (WHERE max_concurrent < 1) AS bad_max_concurrent,
        count(*) FILTER (WHERE source <> 'acl_anthology') AS bad_source FROM crawler_configs""",
    "q_http_outcome": """SELECT event_id, CASE WHEN code = 200 THEN 'ok' WHEN code = 429 OR code >= 500 THEN 'retry' ELSE 'drop' END AS outcome
        FROM (SELECT event_id, [200, 301, 404, 429, 500, 503][event_id % 6 + 1] AS code FROM events)""",
    "q_page_budget": """SELECT DISTINCT _id, CAST(CASE WHEN max_papers IS NULL OR max_papers = 0 THEN 10
        ELSE least((max_papers - 1) // 10 + 1, 10) END AS INT) AS pages FROM crawler_jobs""",
    "q_backoff": """SELECT _id, a.attempt, round(least(pow(2.0, a.attempt) * 60.0 / rate_limit, CAST(max_delay AS DOUBLE)), 6) AS seconds
        FROM crawler_configs, (VALUES (0), (1), (2)) a(attempt) WHERE rate_limit > 0 AND max_delay > 0""",
    "q_trunc_ms": "SELECT event_id, date_trunc('millisecond', ts) AS ts_ms FROM events",
}
