from datetime import datetime

from pyspark.sql import functions as F

from paperlake.operators import jobs as J
from paperlake.operators import reads as R
from paperlake.operators.readmodel import page_text, synthesised_text
from paperlake.streaming.intake import job_stream, reference_state, take_in, without_repeats
from paperlake.schemas import CRAWLER_JOBS


def test_nulls_come_last(spark):
    rows = [("1", None), ("2", datetime(2024, 1, 1)), ("3", datetime(2024, 1, 2)), ("4", datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "_id string, updated_at timestamp_ntz")
    assert [r._id for r in R.get_many(df).collect()] == ["3", "4", "2", "1"]


def test_counts_and_messages(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, n int")
    row = R.update_response(R.update_counts(df, {"n": 2}, F.col("k") == "a")).first()
    assert (row.success, row.matched_count, row.modified_count) == (True, 2, 1)
    row = R.update_response(R.update_counts(df, {"n": 2}, F.col("n") == 2)).first()
    assert (row.success, row.message) == (False, "Documents found but no changes made")
    assert R.update_response(R.update_counts(df, {"n": 2}, F.col("k") == "z")).first().matched_count == 0
    assert R.delete_response(df, F.col("n") > 5).first().success is False
    assert R.deleted(df, F.col("n") < 5).count() == 1


def test_jobs(spark):
    jobs = spark.createDataFrame([("1", "c", "q", None), ("2", "x", "", []), ("3", None, None, ["u"])], "_id string, config_name string, query string, urls array<string>")
    assert [r[0] for r in jobs.orderBy("_id").select(J.has_work(F.col("query"), F.col("urls"))).collect()] == [True, False, True]
    configs = spark.createDataFrame([("c", "acl_anthology", 1, 1, 1, 1, "o")], "name string, source string, rate_limit int, max_delay int, max_attempts int, max_concurrent int, output_dir string")
    state = J.runnable_state(F.col("source").isNotNull(), F.col("source"))
    got = {r._id: r.state for r in J.with_config(jobs, configs).select("_id", state.alias("state")).collect()}
    assert got == {"1": "running", "2": "failed", "3": "failed"}
    batch = spark.createDataFrame([("c", 1), ("d", 3), ("d", 2)], "name string, n int")
    assert [tuple(r) for r in J.new_names(configs, batch, "n").collect()] == [("d", 2)]


def test_texts(spark):
    df = spark.createDataFrame([(["a", "", "b"],), ([],)], "pages array<string>")
    assert [r[0] for r in df.select(page_text(F.col("pages"))).collect()] == ["a\n\nb\n", ""]
    schema = "sections map<string, struct<title: string, content: string, level: int>>"
    df = spark.createDataFrame([({"conclusion": ("End", None, 1), "abstract": ("Abstract", "x", 1)},), ({},), (None,)], schema)
    assert [r[0] for r in df.select(synthesised_text(F.col("sections"))).collect()] == ["1 Abstract\nx\n2 End\n", "", ""]


def test_intake(spark, tmp_path):
    rows = [(f"{i:024x}", datetime(2024, 1, 1), None, "c", "q", None, None, None, None, None, None) for i in range(3)]
    for n in range(3):
        spark.createDataFrame(rows[n : n + 1], CRAWLER_JOBS).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    seen = []
    stream = job_stream(spark, str(tmp_path / "in/*"), files_per_batch=1)
    take_in(without_repeats(stream), lambda df, n: seen.extend(r._id for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == [r[0] for r in rows]


def test_reference_state_grows(spark):
    jobs = spark.createDataFrame([("1", "c", datetime(2024, 1, 1))], "_id string, config_name string, created_at timestamp_ntz")
    configs = spark.createDataFrame([("c", datetime(2024, 1, 2))], "name string, created_at timestamp_ntz")
    state = reference_state(None, children=jobs)
    assert state.first().parents == 0
    state = reference_state(state, parents=configs)
    assert (state.first().refs, state.first().parents) == (1, 1)
