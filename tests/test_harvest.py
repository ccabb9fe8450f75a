"""Crawls over stored pages, and the service on top."""

import pytest
from pyspark.sql import functions as F

from paperlake.operators.harvest import harvest, with_sections
from paperlake.service import BadRequest, Conflict, NotFound, Service
from paperlake.sources.store import Catalog

BASE = "https://anthology.example"
JOBS = "job_id string, urls array<string>, query string, max_papers int"


def paper(i):
    return (f"{BASE}/{i}", f'<meta name="citation_title" content="T {i}"><meta name="citation_author" content="A"><dl><dt>Year:</dt><dd>2020</dd></dl>')


def event(ids, part="x"):
    return f'<div id="{part}">' + "".join(f'<p class="d-sm-flex"><a class="badge" href="/{i}.pdf">p</a></p>' for i in ids) + "</div>"


PAGES = [
    paper("e.1"), paper("e.3"), paper("e.4"), paper("s.1"),
    (f"{BASE}/events/e/", event(["e.1", "e.2", "e.3"]) + event(["e.4"], "y")),
    (f"{BASE}/search/?q=a+b", '<div class="gsc-webResult gsc-result"><a class="gs-title" href="/s.1.pdf">s</a></div>'),
    ("junk", None), (f"{BASE}/events/e/", event(["e.1", "e.2", "e.3"]) + event(["e.4"], "y")),
]


def found(spark, *jobs):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    df = harvest(spark.createDataFrame(list(jobs), JOBS), pages, BASE)
    return sorted((r.job_id, r.source_id) for r in df.collect())


def test_harvest(spark):
    e = f"{BASE}/events/e/"
    assert found(
        spark,
        ("all", [e], None, None),
        ("part", [e + "#y"], None, None),
        ("first part only", [e + "#none", e + "#y"], None, None),
        ("budget", [e], None, 2),
        ("carried on", [e, f"{BASE}/s.1/"], None, 3),
        ("search", None, "a b", None),
        ("zero", [e], None, 0),
        ("empty", [], "", None),
        ("not stored", [f"{BASE}/events/none/", f"{BASE}/none.1"], None, None),
        ("twice", [f"{BASE}/e.1", f"{BASE}/e.1/"], "a b", 5),
        ("twice", [f"{BASE}/e.1", f"{BASE}/e.1/"], "a b", 5),
    ) == sorted(
        [("all", "e.1"), ("all", "e.3"), ("all", "e.4"), ("part", "e.4"), ("budget", "e.1"), ("carried on", "e.1"), ("carried on", "e.3"),
         ("carried on", "s.1"), ("search", "s.1"), ("twice", "e.1"), ("twice", "s.1")]
    )
    assert found(spark, ("none", None, None, None)) == []


def test_harvested_rows(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    row = harvest(spark.createDataFrame([("j", [f"{BASE}/e.1"], None, None)], JOBS), pages, BASE).first()
    assert (row.title, row.authors, row.year, row.url, row.local_pdf_path) == ("T e.1", ["A"], 2020, f"{BASE}/e.1", "crawled_papers/e.1.pdf")


def test_service(spark, tmp_path):
    s = Service(Catalog(spark, str(tmp_path)), BASE)
    config = s.create_config({"name": "c", "source": "acl_anthology"}).ids[0]
    with pytest.raises(Conflict):
        s.create_config({"name": "c"})
    with pytest.raises(NotFound):
        s.create_job({"config_name": "none", "query": "x"})
    with pytest.raises(BadRequest):
        s.create_job({"config_name": "c", "query": ""})
    job = s.create_job({"config_name": "c", "urls": [f"{BASE}/events/e/"]}).ids[0]
    assert s.get("crawler_jobs", job)["status"] is None
    assert s.list("crawler_jobs", status="pending").count() == 0 and s.list("crawler_jobs", status=None).count() == 1
    orphan = s.catalog.collection("crawler_jobs").create_one({"config_name": "gone", "query": "a b"}).ids[0]
    texts = spark.createDataFrame([("crawled_papers/e.1.pdf", "Abstract\nShort.\n1 Introduction\nLong.")], "local_pdf_path string, text string")
    assert s.run_jobs(spark.createDataFrame(PAGES, "url string, html string"), [job, orphan], texts) == 3
    assert s.get("crawler_jobs", job)["status"] == "completed" and s.get("crawler_jobs", orphan)["status"] == "failed"
    papers = {r.source_id: r for r in s.list("papers", job_id=job).collect()}
    assert papers["e.1"].sections["introduction"].content == "Long." and papers["e.3"].sections is None
    assert s.patch("crawler_configs", config, {"rate_limit": 3}).modified_count == 1
    assert s.config_by_name("c")["rate_limit"] == 3
    assert s.delete("crawler_configs", config).deleted_count == 1
    with pytest.raises(NotFound):
        s.get("crawler_configs", config)
    assert s.list("crawler_jobs").where(F.col("config_name") == "c").count() == 1


def test_jobs_fail_one_by_one(spark, tmp_path):
    s = Service(Catalog(spark, str(tmp_path / "data")), BASE)
    s.create_config({"name": "c", "source": "acl_anthology", "output_dir": str(tmp_path / "c")})
    s.create_config({"name": "d", "source": "acl_anthology"})
    s.create_config({"name": "other", "source": "elsewhere"})
    pages = spark.createDataFrame(PAGES, "url string, html string")
    jobs = s.catalog.collection("crawler_jobs")
    good = s.create_job({"config_name": "c", "urls": [f"{BASE}/e.1"]}).ids[0]
    plain = s.create_job({"config_name": "d", "urls": [f"{BASE}/e.3"]}).ids[0]
    unknown = s.create_job({"config_name": "other", "urls": [f"{BASE}/e.1"]}).ids[0]
    bad = s.create_job({"config_name": "c", "urls": [f"{BASE}/e.4"], "max_papers": 66}).ids[0]
    gone = jobs.create_one({"config_name": "gone", "query": "x"}).ids[0]

    class Broken(Service):
        def _of(self, name):
            found = super()._of(name)
            if name == "papers":
                found = _Refusing(found)
            return found

    class _Refusing:
        """A collection that refuses the papers of one job."""

        def __init__(self, inner):
            self.inner = inner

        def create_many(self, papers):
            if papers.where(F.col("job_id") == bad).count():
                raise RuntimeError("refused")
            return self.inner.create_many(papers)

    assert Broken(s.catalog, BASE).run_jobs(pages, [good, plain, unknown, bad, gone]) == 2
    shown = {r._id: (r.status, r.error_message) for r in jobs.rows().collect()}
    assert shown == {
        good: ("completed", None), plain: ("completed", None), bad: ("failed", "refused"),
        unknown: ("failed", "Crawler source 'elsewhere' not implemented"), gone: ("failed", "Configuration 'gone' not found"),
    }
    paths = {r.job_id: r.local_pdf_path for r in s.list("papers").collect()}
    assert paths == {good: f"{tmp_path}/c/e.1.pdf", plain: "crawled_papers/e.3.pdf"}
    assert s.health() == {"status": "healthy"} and "message" in s.root()


def test_a_job_runs_at_once_and_downloads(spark, tmp_path):
    s = Service(Catalog(spark, str(tmp_path / "data")), BASE)
    s.create_config({"name": "c", "source": "acl_anthology", "output_dir": str(tmp_path / "pdf")})
    html = PAGES[0][1] + '<a href="https://a.example/e.1.pdf">PDF</a>'
    pages = spark.createDataFrame([(f"{BASE}/e.1", html)], "url string, html string")
    job = s.create_job({"config_name": "c", "urls": [f"{BASE}/e.1"]}, pages, fetch=lambda url: (200, url.encode())).ids[0]
    assert s.get("crawler_jobs", job)["status"] == "completed"
    row = s.list("papers").first()
    if row.pdf_url:
        assert (tmp_path / "pdf" / "e.1.pdf").read_bytes() == row.pdf_url.encode()


def test_a_repeated_text_repeats_no_paper(spark):
    papers = spark.createDataFrame([("p", "1")], "local_pdf_path string, title string")
    texts = spark.createDataFrame([("p", "Abstract\nShort."), ("p", "Abstract\nShort.")], "local_pdf_path string, text string")
    assert with_sections(papers, texts).count() == 1
