"""URLs, small functions and pages."""

from pyspark.sql import functions as F

from paperlake.functions import html as H
from paperlake.functions import scalars as S
from paperlake.functions import urls as U
from paperlake.sources.web import PageReader, fetch_pages, fetch_with_retry, to_download, write_pdfs


def values(spark, function, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in df.select("i", function(F.col("x"))).orderBy("i").collect()]


def test_urls(spark):
    assert values(spark, U.last_segment, "https://x.org/2023.acl-long.1/", "https://x.org/p?id=1", "///", None) == [
        "2023.acl-long.1", "p?id=1", None, None,
    ]
    assert values(spark, U.route, "/events/a/#l", "/volumes/v", "/search/?q=a", "/Events/x", None) == ["conference", "conference", "search", "paper", None]
    assert values(spark, U.fragment, "u#a#b", "u#", "u") == ["a#b", "", None]
    assert values(spark, U.base_url, "u#a#b", "u#", "u") == ["u", "u", "u"]
    assert values(spark, U.href_to_id, "/2023.acl-long.1.pdf", "/2023.acl-long.1", "/x/") == ["2023.acl-long.1", "2023.acl-long", ""]
    assert values(spark, U.search_href_to_id, "/2023.acl-long.1.pdf", "/2023.acl-long.1/") == ["2023.acl-long.1"] * 2
    assert values(spark, U.mask_credentials, "mongodb://u:p@h:1/d", "mongodb://h:1/d") == ["mongodb://***:***@h:1/d", "mongodb://h:1/d"]


def test_scalars(spark):
    assert values(spark, S.try_year, "2023", "20x", "", None, " 7 ") == [2023, None, None, None, 7]
    assert values(spark, S.venues, "ACL | WS", "", None) == [["ACL ", " WS"], [], []]
    pages = lambda x: S.page_budget(x.cast("int"))
    assert values(spark, pages, None, "1", "10", "11", "1000") == [10, 1, 1, 2, 10]
    wait = lambda x: S.backoff(F.lit(10), x.cast("int"), F.lit(60))
    assert values(spark, wait, "0", "1", "2", "9") == [6, 12, 24, 60]
    assert values(spark, lambda x: S.http_outcome(x.cast("int")), "200", "404", "429", "503", None) == ["ok", "drop", "retry", "retry", None]


PAPER = """<html><head><meta name="citation_title" content="A &amp; B"><meta content="Ann" name="citation_author">
<meta name="citation_author" content="Bob"></head><body><dl><dt>PDF:</dt><dd><a href="x">https://x/y.pdf</a></dd>
<dt>Year:</dt><dd> 2021 </dd><dt>Venues:</dt><dd>ACL | WS</dd></dl></body></html>"""
EVENT = """<div id="long"><p class="d-sm-flex a"><span><a class="badge b" href="/2023.x-long.1.pdf">pdf</a></span><br></p></div>
<div id="short"><p class="d-sm-flex"><a class="badge" href="/2023.x-short.2.pdf">pdf</a></p></div>"""


def test_pages():
    assert H.paper_of(PAPER) == {"title": "A & B", "authors": ["Ann", "Bob"], "pdf_url": "https://x/y.pdf", "year": 2021, "venues": ["ACL ", " WS"]}
    assert H.paper_of("<p>none</p>") is None and H.paper_of(None) is None and H.paper_of("") is None
    assert H.paper_of('<meta name="citation_title">') is None
    assert H.conference_ids(EVENT) == ["2023.x-long.1", "2023.x-short.2"]
    assert H.conference_ids(EVENT, "short") == ["2023.x-short.2"]
    assert H.conference_ids(EVENT, "none") == [] and H.conference_ids("") == []
    assert H.conference_ids(EVENT + '<p class="d-sm-flex">bad</p>') == []
    found = '<div class="gsc-webResult gsc-result"><a class="gs-title" href="https://x.org/2023.a.1.pdf">t</a></div>'
    assert H.search_ids(found) == ["2023.a.1"]
    assert H.search_ids(found + '<div class="gsc-webResult gsc-result"></div>') == []
    assert H.search_ids('<div class="gsc-result gsc-webResult"></div>') == []
    assert len(H.conference_ids("<div>" * 5000 + EVENT)) == 2


def test_page_operators(spark):
    pages = spark.createDataFrame([("a", PAPER), ("b", "<p>"), ("c", None)], "page_id string, html string")
    assert [(r.page_id, r.year) for r in H.extract_papers(pages).collect()] == [("a", 2021)]
    lists = spark.createDataFrame([("e", "conference", None, EVENT), ("s", "search", None, None)], "page_id string, kind string, part string, html string")
    assert [(r.place, r.id) for r in H.extract_ids(lists).collect()] == [(0, "2023.x-long.1"), (1, "2023.x-short.2")]


def test_retry():
    answers = iter([(503, b""), (429, b""), (200, b"x")])
    waits = []
    assert fetch_with_retry("u", lambda _: next(answers), sleep=waits.append) == b"x"
    assert len(waits) == 2 and 4.5 <= waits[0] <= 7.5 and 9 <= waits[1] <= 15
    assert fetch_with_retry("u", lambda _: (404, b""), sleep=waits.append) is None and len(waits) == 2

    def refuse(_):
        raise OSError

    assert fetch_with_retry("u", refuse, sleep=lambda _: None) is None


def test_page_source_partitions():
    reader = PageReader({"urls": '["a", "b", "a", "c"]', "partitions": "2"})
    assert sorted(u for p in reader.partitions() for u in p.urls) == ["a", "b", "c"]


def test_pdf_files(spark, tmp_path):
    path = str(tmp_path / "pdfs" / "a.pdf")
    papers = spark.createDataFrame([("http://x/a.pdf", path), ("http://x/b.pdf", None), (None, "p"), ("", "p")], "pdf_url string, local_pdf_path string")
    assert to_download(papers).count() == 1
    write_pdfs(to_download(papers), lambda _: (200, b"%PDF"))
    assert open(path, "rb").read() == b"%PDF"
    assert to_download(papers).count() == 0


def test_a_file_elsewhere_hides_none(spark, tmp_path):
    a, b = str(tmp_path / "a" / "x.pdf"), str(tmp_path / "b" / "x.pdf")
    papers = spark.createDataFrame([("http://x/1.pdf", a), ("http://x/2.pdf", b)], "pdf_url string, local_pdf_path string")
    write_pdfs(papers.limit(1), lambda _: (200, b"%PDF"))
    assert [r.local_pdf_path for r in to_download(papers).collect()] == [b]


def test_fetch_pages(spark):
    answers = {"http://a.example/1": (200, b"one"), "http://a.example/2": (404, b""), "http://b.example/1": (200, "zwei é".encode())}
    urls = spark.createDataFrame([(u,) for u in answers] + [(None,), ("http://a.example/1",)], "url string")
    got = {r.url: r.html for r in fetch_pages(urls, rate_limit=6000, fetch=lambda u: answers[u]).collect()}
    assert got == {"http://a.example/1": "one", "http://a.example/2": None, "http://b.example/1": "zwei é"}
