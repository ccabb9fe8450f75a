"""Pages from the web, and PDF files from and to a folder.

`fetch_pages` fetches a table of addresses.  All addresses of a host go to one
task, which keeps to the rate and to the number of requests at a time that the
host is asked for; hosts are fetched side by side.  `PageSource` offers the
same for a short list as a data source.  `fetch` may be replaced, which is how
both are tested without a network.
"""

from __future__ import annotations

import json
import random
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds that one request may take.
TIMEOUT = 30.0
#: Names that requests go by in turn.
AGENTS = tuple(f"Mozilla/5.0 (compatible; paperlake/{n})" for n in range(1, 6))


def http_get(url: str) -> tuple[int, bytes]:
    """Status and body of an address."""
    request = urllib.request.Request(url, headers={"User-Agent": random.choice(AGENTS)})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def fetch_with_retry(
    url: str,
    fetch: Callable[[str], tuple[int, bytes]] = http_get,
    *,
    rate_limit: int = 10,
    max_delay: int = 60,
    max_attempts: int = 3,
    sleep: Callable[[float], None] = time.sleep,
) -> bytes | None:
    """Body of an address, or None.  Timeouts, refusals, 429 and 5xx are tried again, all else is dropped."""
    delay = 60 / rate_limit
    for attempt in range(max_attempts):
        try:
            status, body = fetch(url)
            if status == 200:
                return body
            if status != 429 and status < 500:
                return None
        except (OSError, TimeoutError):
            pass
        if attempt + 1 < max_attempts:
            sleep(min(2**attempt * delay, max_delay) * random.uniform(0.75, 1.25))
    return None


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = list(dict.fromkeys(json.loads(options.get("urls", "[]"))))
        self.n = max(1, int(options.get("partitions", "4")))
        self.rate = int(options.get("rate_limit", "10"))
        self.attempts = int(options.get("max_attempts", "3"))
        self.most = int(options.get("max_delay", "60"))

    def partitions(self) -> list[_Part]:
        parts = [_Part(self.urls[i :: self.n]) for i in range(self.n)]
        return [p for p in parts if p.urls] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        # Each partition keeps to its share of the rate.
        pause = 60 / self.rate * min(self.n, max(1, len(self.urls)))
        for i, url in enumerate(partition.urls):
            if i:
                time.sleep(pause)
            body = fetch_with_retry(url, rate_limit=self.rate, max_delay=self.most, max_attempts=self.attempts)
            yield url, body.decode("utf-8", "replace") if body is not None else None


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("pages").option("urls", json).load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def fetched(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Seeds (url, ...) with the html that was stored for them; null where a fetch failed.  Pages are one per url."""
    return seeds.join(pages.select("url", "html").dropDuplicates(["url"]), "url", "left")


class _Pace:
    """Lets requests begin no faster than one every so many seconds."""

    def __init__(self, seconds: float) -> None:
        self.seconds, self.next, self.lock = seconds, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.seconds
        time.sleep(at - now)


def fetch_pages(
    urls: DataFrame,
    *,
    rate_limit: int = 10,
    max_delay: int = 60,
    max_attempts: int = 3,
    max_concurrent: int = 10,
    fetch: Callable[[str], tuple[int, bytes]] = http_get,
) -> DataFrame:
    """(url, html) of every distinct address of `urls` (column url); html is null where it failed.

    A host is asked `rate_limit` times a minute, by at most `max_concurrent`
    requests at a time.  Null addresses are left out.
    """
    schema = pa.schema([("url", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paces: dict[str, _Pace] = {}

        def one(url: str) -> str | None:
            host = urllib.parse.urlsplit(url).netloc

            def paced(url: str) -> tuple[int, bytes]:
                paces.setdefault(host, _Pace(60 / rate_limit)).wait()
                return fetch(url)

            body = fetch_with_retry(url, paced, rate_limit=rate_limit, max_delay=max_delay, max_attempts=max_attempts)
            return body.decode("utf-8", "replace") if body is not None else None

        with ThreadPoolExecutor(max_concurrent) as pool:
            for batch in batches:
                wanted = batch.column(0).to_pylist()
                # Few at a time, so that no more than these bodies are held.
                for i in range(0, len(wanted), 100):
                    part = wanted[i : i + 100]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(pool.map(one, part)), pa.string())], schema=schema)

    host = F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1)
    return urls.select("url").where(F.col("url").isNotNull()).distinct().repartition(host).mapInArrow(run, "url string, html string")


def _full_path(spark: SparkSession, path: Column) -> Column:
    """A path with its file system, as Hadoop names it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.FileSystem.get(spark._jsc.hadoopConfiguration())
    root = str(fs.getUri().toString()).rstrip("/")
    root = root + ":" if root == "file" else root
    here = str(fs.getWorkingDirectory().toString()).rstrip("/")
    clean = F.regexp_replace(F.regexp_replace(path, r"(?<!:)/{2,}", "/"), r"^(\./)+", "")
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), clean).when(path.startswith("/"), F.concat(F.lit(root.removesuffix("//")), clean)).otherwise(
        F.concat(F.lit(here + "/"), clean)
    )


def to_download(papers: DataFrame) -> DataFrame:
    """Papers with an address and a path whose file isn't there yet.

    Paths are compared in full, so that a file of the same name elsewhere hides
    none.  Folders that hold papers are listed by Spark; contents aren't read.
    """
    spark = papers.sparkSession
    ready = papers.where((F.length("pdf_url") > 0) & (F.length("local_pdf_path") > 0)).withColumn("_file", _full_path(spark, F.col("local_pdf_path")))
    hadoop = spark._jvm.org.apache.hadoop.fs
    # One row for each configured folder.
    folders = [r[0] for r in ready.select(F.regexp_extract("_file", "^(.*)/[^/]*$", 1)).distinct().collect()]
    there = [f for f in folders if hadoop.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(f))]
    if not there:
        return ready.drop("_file")
    files = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "file:/").alias("_file"))
    return ready.join(files, "_file", "left_anti").drop("_file")


def write_pdfs(papers: DataFrame, fetch: Callable[[str], tuple[int, bytes]] = http_get, max_concurrent: int = 10) -> None:
    """Store the file of every paper (pdf_url, local_pdf_path) in the file system of its path; failed fetches and writes are passed over."""

    def store(rows: Iterator) -> None:
        from pyarrow import fs

        def one(r) -> None:
            body = fetch_with_retry(r.pdf_url, fetch, max_attempts=1)
            if body:
                try:
                    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", r.file))
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(path) as file:
                        file.write(body)
                except (OSError, pa.ArrowException):
                    pass

        with ThreadPoolExecutor(max_concurrent) as pool:
            waiting: list = []
            for r in rows:
                waiting.append(r)
                if len(waiting) == 100:
                    list(pool.map(one, waiting))
                    waiting = []
            list(pool.map(one, waiting))

    papers.select("pdf_url", _full_path(papers.sparkSession, F.col("local_pdf_path")).alias("file")).distinct().foreachPartition(store)


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the PDF files in a folder: the pages' texts, each with a line end.

    Needs pypdf where the executors run.  A file that can't be read has a null text.
    """
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e

    def rows(batches: Iterator) -> Iterator:
        import io

        import pandas as pd
        import pypdf

        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append("".join(page.extract_text() + "\n" for page in pypdf.PdfReader(io.BytesIO(content)).pages))
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(rows, "path string, text string")
