"""Queries on URLs, pages, crawl plans and headed sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import html as H
from paperlake.functions import urls as U
from paperlake.functions.scalars import try_year, venues
from paperlake.operators import crawl as C
from paperlake.operators import sections as S
from paperlake.operators.readmodel import page_text, read_model, synthesised_text
from paperlake.session import table
from paperlake.sources.web import fetched

BASE = "https://anthology.example"


def _papers(spark: SparkSession, data: str) -> DataFrame:
    """All stored rows of papers; a paper stored twice is read twice."""
    return table(spark, data, "papers")


def _texts(spark: SparkSession, data: str) -> DataFrame:
    """(paper_id, text): the text of every row of papers, normalised.  What is found in repeats is made distinct, not the texts."""
    papers = table(spark, data, "papers")
    return papers.select(F.col("_id").alias("paper_id"), S.normalize(synthesised_text(F.col("sections"))).alias("text"))


def q_flagship_read_model(spark: SparkSession, data: str) -> DataFrame:
    return read_model(_papers(spark, data), synthesised_text(F.col("sections")))


def q_normalize_text(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "documents").select("doc_id", S.normalize(F.col("text")).alias("text"))


def q_line_offsets(spark: SparkSession, data: str) -> DataFrame:
    lines = table(spark, data, "documents").select("doc_id", F.explode(S.line_spans(F.col("text"))).alias("x"))
    return lines.select("doc_id", F.col("x.start").alias("start_char"), F.col("x.n_chars").alias("n_chars"))


def q_find_headings(spark: SparkSession, data: str) -> DataFrame:
    found = _texts(spark, data).select("paper_id", F.explode(S.headings(F.col("text"))).alias("h"))
    return found.select("paper_id", F.col("h.title").alias("title"), F.col("h.level").alias("level"), F.col("h.start").alias("start_char")).distinct()


def q_unnumbered_headings(spark: SparkSession, data: str) -> DataFrame:
    """Headings without a number, in texts with other line ends, around a line that is none: every paper's title after a dash."""
    title = F.concat(F.lit("- "), F.regexp_replace(F.coalesce("title", F.lit("")), r"[\s\x1c-\x1f\x85\u2028\u2029]", " "))
    parts = [F.lit("Abstract\r\n"), title, F.lit("\x0cEthics Statement\x0bNot a Heading\u2028limitations\rReferences\x85"), title]
    texts = table(spark, data, "papers").select(F.col("_id").alias("paper_id"), F.concat(*parts).alias("text"))
    found = texts.select("paper_id", F.explode(S.headings(F.col("text"))).alias("h"))
    return found.select("paper_id", F.col("h.title").alias("title"), F.col("h.level").alias("level"), F.col("h.start").alias("start_char")).distinct()


def _sections(spark: SparkSession, data: str) -> DataFrame:
    return _texts(spark, data).select("paper_id", F.explode(S.sections(F.col("text"))).alias("s"))


def q_section_spans(spark: SparkSession, data: str) -> DataFrame:
    return _sections(spark, data).select("paper_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char")).distinct()


def q_section_content(spark: SparkSession, data: str) -> DataFrame:
    return _sections(spark, data).select("paper_id", F.col("s.start").alias("start_char"), F.col("s.content").alias("content")).distinct()


def q_classify_heading(spark: SparkSession, data: str) -> DataFrame:
    titles = table(spark, data, "papers").select(F.explode(F.map_values("sections")).alias("s")).select("s.title")
    parts = table(spark, data, "part").select(F.col("p_name").alias("title"))
    return titles.unionByName(parts).distinct().select("title", S.section_type(F.col("title")).alias("section_type"))


def q_heading_slug(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "papers").select("title").distinct().select("title", S.slug(F.col("title")).alias("slug"))


def q_last_write_wins(spark: SparkSession, data: str) -> DataFrame:
    """The last occurrence of each section type in a text that holds every paper's sections twice, reversed the second time."""
    papers = _papers(spark, data)
    once = synthesised_text(F.col("sections"))
    text = S.normalize(F.concat(once, F.lit("\n7 Background\nagain\n8 Summary\nonce more\n")))
    m = papers.select(F.col("_id").alias("paper_id"), S.section_map(text, S.WANTED).alias("m"))
    return m.select("paper_id", F.explode("m").alias("section_type", "s")).select("paper_id", "section_type", "s.title", "s.level").distinct()


def q_section_whitelist(spark: SparkSession, data: str) -> DataFrame:
    kept = _papers(spark, data).select(F.col("_id").alias("paper_id"), S.only_sections(F.col("sections"), ("abstract", "conclusion")).alias("m"))
    return kept.select("paper_id", F.array_sort(F.map_keys("m")).alias("kept"))


def q_missing_sections(spark: SparkSession, data: str) -> DataFrame:
    return _papers(spark, data).select(F.col("_id").alias("paper_id"), F.array_sort(S.missing_sections(F.col("sections"))).alias("missing"))


def q_text_concat(spark: SparkSession, data: str) -> DataFrame:
    """Texts of a paper's sections, in the order of their keys, as pages of one text."""
    pages = F.transform(F.array_sort(F.map_keys("sections")), lambda k: F.coalesce(F.col("sections")[k]["content"], F.lit("")))
    return _papers(spark, data).select(F.col("_id").alias("paper_id"), page_text(pages).alias("text"))


def _seeds(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs").dropDuplicates(["_id"])
    return jobs.select(F.col("_id").alias("job_id"), F.posexplode("urls").alias("seed_no", "url"))


def q_url_route(spark: SparkSession, data: str) -> DataFrame:
    extra = table(spark, data, "papers").select("url").where(F.col("url").isNotNull())
    urls = _seeds(spark, data).select("url").unionByName(extra).distinct()
    return urls.select("url", U.route(F.col("url")).alias("route"))


def q_url_last_segment(spark: SparkSession, data: str) -> DataFrame:
    return _seeds(spark, data).select("url").distinct().select("url", U.last_segment(F.col("url")).alias("segment"))


def q_url_fragment(spark: SparkSession, data: str) -> DataFrame:
    urls = _seeds(spark, data).select("url").distinct()
    return urls.select("url", U.base_url(F.col("url")).alias("base"), U.fragment(F.col("url")).alias("fragment"))


def q_href_to_id(spark: SparkSession, data: str) -> DataFrame:
    urls = table(spark, data, "papers").select("pdf_url").where(F.col("pdf_url").isNotNull()).distinct()
    return urls.select("pdf_url", U.href_to_id(F.col("pdf_url")).alias("id"))


def q_search_href_to_id(spark: SparkSession, data: str) -> DataFrame:
    urls = table(spark, data, "papers").select("source_id").distinct()
    return urls.select("source_id", U.search_href_to_id(F.col("source_id")).alias("id"))


def q_search_url(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs").where(F.col("query").isNotNull()).select("query").distinct()
    return jobs.select("query", U.search_url(BASE, F.col("query")).alias("url"))


def q_derived_paths(spark: SparkSession, data: str) -> DataFrame:
    ids = table(spark, data, "papers").select("source_id").distinct()
    return ids.select("source_id", U.paper_url(BASE, F.col("source_id")).alias("url"), U.pdf_path(F.lit("crawled_papers"), F.col("source_id")).alias("path"))


def q_split_venues(spark: SparkSession, data: str) -> DataFrame:
    joined = F.array_join("venues", "|")
    return _papers(spark, data).select(F.col("_id").alias("paper_id"), venues(joined).alias("venues"))


def q_try_year(spark: SparkSession, data: str) -> DataFrame:
    ids = table(spark, data, "papers").select("source_id").distinct()
    return ids.select("source_id", try_year(F.substring_index("source_id", ".", 1)).alias("year"))


def q_mask_uri(spark: SparkSession, data: str) -> DataFrame:
    customer = table(spark, data, "customer")
    user = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    uri = U.store_uri(F.lit("db"), F.lit(27017), F.lit("papers"), user, F.lit("secret"))
    return customer.select("c_custkey", U.mask_credentials(uri).alias("uri"))


def _pages(spark: SparkSession, data: str) -> DataFrame:
    """A page per paper with its stored values, as the archive would show them."""
    papers = _papers(spark, data)
    metas = F.concat(
        F.when(F.col("title").isNotNull(), F.concat(F.lit('<meta name="citation_title" content="'), H.escape(F.col("title")), F.lit('">'))).otherwise(F.lit("")),
        F.array_join(
            F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit('<meta name="citation_author" content="'), H.escape(a), F.lit('">'))),
            "\n",
        ),
    )
    dd = lambda label, value: F.when(
        value.isNotNull(), F.concat(F.lit(f"<dt>{label}</dt>\n<dd> <b>"), H.escape(value), F.lit("</b></dd>"))
    ).otherwise(F.lit(""))
    body = F.concat(
        F.lit("<body><dl>"),
        dd("PDF:", F.col("pdf_url")),
        dd("Year:", F.col("year").cast("string")),
        dd("Venues:", F.array_join("venues", "|")),
        F.lit('</dl><div class="ad">none<br></div></body>'),
    )
    return papers.select(
        F.col("_id").alias("page_id"), "url", "pdf_url", "year", "title", "authors", "venues",
        F.concat(F.lit("<html><head>"), metas, F.lit("</head>"), body, F.lit("</html>")).alias("html"),
    )


def q_html_title(spark: SparkSession, data: str) -> DataFrame:
    return _pages(spark, data).select("page_id", H.meta_content(F.col("html"), H.TITLE).alias("title"))


def q_html_collect(spark: SparkSession, data: str) -> DataFrame:
    return _pages(spark, data).select("page_id", H.meta_contents(F.col("html"), H.AUTHOR).alias("authors"))


def q_html_labelled(spark: SparkSession, data: str) -> DataFrame:
    fields = H.paper_fields(F.col("html"))
    return _pages(spark, data).select("page_id", *fields).select("page_id", "pdf_url", "year", "venues")


def q_html_parsed(spark: SparkSession, data: str) -> DataFrame:
    """The same fields by the page parser."""
    return H.extract_papers(_pages(spark, data)).select("page_id", "title", "authors", "year")


def _event_pages(spark: SparkSession, data: str) -> DataFrame:
    """A page per year and venue that lists its papers, one entry of some pages without a link."""
    ids = _canonical(table(spark, data, "papers").select("source_id")).select("id").distinct()
    ids = ids.withColumn("page_id", F.regexp_extract("id", r"^(.*)\.\d+$", 1)).where(F.col("page_id") != "")
    bad = F.col("id").endswith(".3")
    link = F.when(bad, F.lit('<span class="badge">PDF</span>')).otherwise(
        F.concat(F.lit(f'<a class="badge badge-primary" href="{BASE}/'), F.col("id"), F.lit('.pdf">PDF</a>'))
    )
    entry = F.concat(F.lit('<p class="d-sm-flex align-items-stretch">'), link, F.lit("<br></p>"))
    return ids.groupBy("page_id").agg(
        F.concat(F.lit("<div>"), F.array_join(F.array_sort(F.collect_list(entry)), "\n"), F.lit("</div>")).alias("html")
    )


def _canonical(df: DataFrame) -> DataFrame:
    lower = F.regexp_replace(F.lower(F.trim("source_id")), r"/+$", "")
    return df.withColumn("id", F.replace(F.regexp_replace(F.regexp_extract(lower, "([^/]*)$", 1), r"\.pdf$", ""), F.lit("_"), F.lit("-")))


def q_html_by_class(spark: SparkSession, data: str) -> DataFrame:
    """Ids on the event pages; a page with a malformed entry gives none."""
    pages = _event_pages(spark, data).select("page_id", F.lit("conference").alias("kind"), F.lit(None).cast("string").alias("part"), "html")
    return H.extract_ids(pages).select("page_id", "id")


def q_all_or_nothing(spark: SparkSession, data: str) -> DataFrame:
    entries = F.regexp_extract_all("html", F.lit("(?s)<p [^>]*>.*?</p>"), F.lit(0))
    ids = F.transform(entries, lambda e: F.nullif(U.href_to_id(F.regexp_extract(e, 'href="([^"]*)"', 1)), F.lit("")))
    return _event_pages(spark, data).select("page_id", F.size(H.all_or_nothing(ids)).alias("n_ids"))


def q_extract_success_ratio(spark: SparkSession, data: str) -> DataFrame:
    pages = _pages(spark, data).select("year", H.labelled(F.col("html"), H.PDF_LABEL).alias("pdf"))
    return pages.groupBy("year").agg(F.count(F.lit(1)).alias("n_found"), F.count("pdf").alias("n_ok"))


def q_fetch_join(spark: SparkSession, data: str) -> DataFrame:
    """What the papers' own addresses and the seeds would fetch from the pages that are stored."""
    pages = _pages(spark, data).where(F.col("url").isNotNull() & (F.col("year") >= 2000)).select("url", F.lit("page").alias("html"))
    seeds = table(spark, data, "papers").select("url").unionByName(_seeds(spark, data).select("url")).where(F.col("url").isNotNull()).distinct()
    return fetched(seeds, pages).select("url", F.col("html").isNotNull().alias("fetched"))


def q_visited_first(spark: SparkSession, data: str) -> DataFrame:
    """The seed that first visits an address in each job, fragments aside."""
    visits = _seeds(spark, data).withColumn("base", U.base_url(F.col("url")))
    return C.first_visits(visits, "job_id", "base", order=("seed_no",)).select("job_id", "base", "seed_no")


def q_union_seeds(spark: SparkSession, data: str) -> DataFrame:
    jobs = table(spark, data, "crawler_jobs").dropDuplicates(["_id"])
    urls = _seeds(spark, data).select("job_id", "seed_no", F.col("url").alias("seed"))
    searches = jobs.where(F.length("query") > 0).select(
        F.col("_id").alias("job_id"), F.coalesce(F.size("urls"), F.lit(0)).alias("seed_no"), U.search_url(BASE, F.col("query")).alias("seed")
    )
    return urls.unionByName(searches)


def q_slice_before_filter(spark: SparkSession, data: str) -> DataFrame:
    papers = _papers(spark, data).where(F.col("job_id").isNotNull()).select("_id", "job_id", "pdf_url").distinct()
    kept = C.slice_then_filter(papers, "job_id", ("_id",), 5, F.coalesce(F.col("pdf_url").endswith(".pdf"), F.lit(False)))
    return kept.select("job_id", "_id")


def q_budget_fold(spark: SparkSession, data: str) -> DataFrame:
    """What each job finds: its papers' events are the seeds, a paper without a PDF address fails."""
    papers = _canonical(_papers(spark, data).select("_id", "job_id", "source_id", "pdf_url")).where(F.length("id") > 0)
    one = papers.groupBy("job_id", "id").agg(F.min("_id").alias("place"), F.bool_or(F.coalesce(F.col("pdf_url").endswith(".pdf"), F.lit(False))).alias("ok"))
    candidates = one.select(
        "job_id", F.regexp_extract("id", r"^(.*)\.\d+$", 1).alias("seed_no"), F.lit(None).cast("string").alias("page"), "place", "id", "ok"
    )
    jobs = table(spark, data, "crawler_jobs").select(F.col("_id").alias("job_id"), "max_papers").distinct()
    return C.plan(candidates, jobs)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_NORM = "trim(regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), '\\n[\\s\\p{{Z}}\\x1c-\\x1f\\x85]*\\n', chr(10) || chr(10), 'g'), E' \\n\\t\\r')"
_CLASS = """CASE WHEN regexp_matches(lower({0}), '\\b(abstract|summary)\\b') THEN 'abstract'
  WHEN regexp_matches(lower({0}), '\\b(introduction|background|motivation)\\b') THEN 'introduction'
  WHEN regexp_matches(lower({0}), '\\b(conclusions?|final\\s+thoughts)\\b') THEN 'conclusion'"""
_SLUG = "replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x1c-\\x1f\\x85]', '_', 'g'), ' ', '_')"
# Sections of a paper one after another, each with its heading; n counts them in order.
_PARTS = """
one AS (SELECT DISTINCT ON (_id) * FROM papers),
part AS (
  SELECT _id, title, authors, year, url, x.k, sections[x.k].title AS t, coalesce(sections[x.k].content, '') AS c,
         row_number() OVER (PARTITION BY _id ORDER BY x.o) AS n
  FROM one, (VALUES ('abstract', 1), ('introduction', 2), ('conclusion', 3)) x(k, o)
  WHERE list_contains(map_keys(sections), x.k)
)"""
_TEXT = f"""WITH RECURSIVE {_PARTS},
whole AS (
  SELECT _id, {_NORM.format("string_agg(n || ' ' || t || chr(10) || c, chr(10) ORDER BY n)")} AS text FROM part GROUP BY _id
), line AS (
  SELECT _id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM whole
), placed AS (
  SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY _id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM line
), head AS (
  SELECT _id, text, pos, trim(regexp_extract(trim(l), '^(?:[A-Z]|\\d+)(?:\\.\\d+)*\\s+((?:[A-Z]|\\d+)[A-Za-z\\s:-]+)$', 1)) AS title,
         len(string_split(regexp_extract(trim(l), '^((?:[A-Z]|\\d+)(?:\\.\\d+)*)', 1), '.')) AS level
  FROM placed WHERE regexp_matches(trim(l), '^(?:[A-Z]|\\d+)(?:\\.\\d+)*\\s+(?:[A-Z]|\\d+)[A-Za-z\\s:-]+$')
), span AS (
  SELECT *, lead(pos, 1, length(text)) OVER (PARTITION BY _id ORDER BY pos) AS until FROM head
)"""
_CUT = "trim(regexp_replace(trim(substr(text, CAST(pos AS BIGINT) + 1, CAST(until - pos AS BIGINT)), E' \\n\\t\\r'), '^[^\\n]*(\\n|$)', ''), E' \\n\\t\\r')"
_CANON = "replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(source_id)), '/+$', ''), '([^/]*)$', 1), '\\.pdf$', ''), '_', '-')"
_SEED = "SELECT _id AS job_id, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS seed_no FROM (SELECT DISTINCT ON (_id) * FROM crawler_jobs)"
_PAGE = "SELECT _id AS page_id, title, authors, pdf_url, year, venues, url FROM papers"

SQL = {
    "q_flagship_read_model": f"""{_TEXT}, cut AS (
        SELECT _id, pos, {_CLASS.format("title")} END AS k, {_CUT} AS content FROM span
      )
      SELECT p._id, p.title, p.authors, p.year, p.url,
        (SELECT arg_max(content, pos) FROM cut WHERE cut._id = p._id AND k = 'abstract') AS abstract,
        (SELECT arg_max(content, pos) FROM cut WHERE cut._id = p._id AND k = 'introduction') AS introduction,
        (SELECT arg_max(content, pos) FROM cut WHERE cut._id = p._id AND k = 'conclusion') AS conclusion
      FROM papers p""",
    "q_normalize_text": f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents",
    "q_line_offsets": """WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i,
          len(string_split(text, chr(10))) AS n FROM documents
      ), m AS (
        SELECT doc_id, i, n, CAST(length(x) + CASE WHEN i < n THEN 1 ELSE 0 END AS INT) AS n_chars FROM l
      )
      SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_char, n_chars
      FROM m WHERE n_chars > 0""",
    "q_unnumbered_headings": """
      WITH t AS (SELECT DISTINCT _id, coalesce(length(title), 0) + 2 AS n FROM papers)
      SELECT _id AS paper_id, 'Abstract' AS title, 1 AS level, 0 AS start_char FROM t
      UNION SELECT _id, 'Ethics Statement', 1, CAST(11 + n AS INT) FROM t
      UNION SELECT _id, 'References', 1, CAST(54 + n AS INT) FROM t""",
    "q_find_headings": f"{_TEXT} SELECT DISTINCT _id AS paper_id, title, CAST(level AS INT) AS level, CAST(pos AS INT) AS start_char FROM head",
    "q_section_spans": f"{_TEXT} SELECT DISTINCT _id AS paper_id, CAST(pos AS INT) AS start_char, CAST(until AS INT) AS end_char FROM span",
    "q_section_content": f"{_TEXT} SELECT DISTINCT _id AS paper_id, CAST(pos AS INT) AS start_char, {_CUT} AS content FROM span",
    "q_classify_heading": f"""SELECT title, {_CLASS.format("title")} ELSE {_SLUG.format("title")} END AS section_type FROM (
        SELECT unnest(map_values(sections)).title AS title FROM papers UNION SELECT p_name FROM part)""",
    "q_heading_slug": f"SELECT DISTINCT title, {_SLUG.format('title')} AS slug FROM papers",
    "q_last_write_wins": f"""WITH {_PARTS}
      SELECT DISTINCT _id AS paper_id, 'introduction' AS section_type, 'Background' AS title, 1 AS level FROM one
      UNION ALL SELECT _id, 'abstract', 'Summary', 1 FROM one
      UNION ALL SELECT _id, 'conclusion', t, 1 FROM part WHERE k = 'conclusion'""",
    "q_section_whitelist": """SELECT _id AS paper_id, list_sort(list_filter(map_keys(sections), lambda k: k IN ('abstract', 'conclusion'))) AS kept
      FROM papers""",
    "q_missing_sections": """SELECT _id AS paper_id, list_filter(['abstract', 'conclusion', 'introduction'],
      lambda k: NOT list_contains(map_keys(sections), k)) AS missing FROM papers""",
    "q_text_concat": """WITH o AS (SELECT DISTINCT ON (_id) * FROM papers), s AS (SELECT _id, unnest(map_entries(sections)) AS e FROM o)
      SELECT p._id AS paper_id, coalesce((SELECT string_agg(coalesce(e.value.content, '') || chr(10), '' ORDER BY e.key) FROM s WHERE s._id = p._id), '') AS text FROM papers p""",
    "q_url_route": f"""SELECT url, CASE WHEN contains(url, '/events/') OR contains(url, '/volumes/') THEN 'conference'
      WHEN contains(url, '/search/') THEN 'search' ELSE 'paper' END AS route
      FROM (SELECT url FROM ({_SEED}) UNION SELECT url FROM papers WHERE url IS NOT NULL)""",
    "q_url_last_segment": f"SELECT DISTINCT url, list_filter(string_split(url, '/'), lambda p: p <> '')[-1] AS segment FROM ({_SEED})",
    "q_url_fragment": f"""SELECT DISTINCT url, CASE WHEN strpos(url, '#') > 0 THEN substr(url, 1, strpos(url, '#') - 1) ELSE url END AS base,
      CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#') + 1) END AS fragment FROM ({_SEED})""",
    "q_href_to_id": "SELECT DISTINCT pdf_url, regexp_replace(string_split(pdf_url, '/')[-1], '\\.[^.]*$', '') AS id FROM papers WHERE pdf_url IS NOT NULL",
    "q_search_href_to_id": "SELECT DISTINCT source_id, regexp_replace(string_split(trim(source_id, '/'), '/')[-1], '\\.pdf$', '') AS id FROM papers",
    "q_search_url": f"SELECT DISTINCT query, '{BASE}/search/?q=' || replace(query, ' ', '+') AS url FROM crawler_jobs WHERE query IS NOT NULL",
    "q_derived_paths": f"SELECT DISTINCT source_id, '{BASE}/' || source_id AS url, 'crawled_papers/' || source_id || '.pdf' AS path FROM papers",
    "q_split_venues": """SELECT _id AS paper_id, CASE WHEN array_to_string(venues, '|') = '' OR venues IS NULL THEN [] ELSE string_split(array_to_string(venues, '|'), '|') END AS venues
      FROM papers""",
    "q_try_year": "SELECT DISTINCT source_id, TRY_CAST(nullif(trim(string_split(source_id, '.')[1]), '') AS INT) AS year FROM papers",
    "q_mask_uri": """SELECT c_custkey, 'mongodb://' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '***:***@' END || 'db:27017/papers' AS uri FROM customer""",
    "q_html_title": f"SELECT page_id, title FROM ({_PAGE})",
    "q_html_collect": f"SELECT page_id, coalesce(authors, []) AS authors FROM ({_PAGE})",
    "q_html_labelled": f"""SELECT page_id, nullif(trim(pdf_url), '') AS pdf_url, year,
      CASE WHEN trim(array_to_string(venues, '|')) = '' OR venues IS NULL THEN [] ELSE string_split(trim(array_to_string(venues, '|')), '|') END AS venues FROM ({_PAGE})""",
    "q_html_parsed": f"SELECT page_id, title, coalesce(authors, []) AS authors, year FROM ({_PAGE}) WHERE title IS NOT NULL",
    "q_html_by_class": f"""WITH i AS (SELECT DISTINCT {_CANON} AS id FROM papers), p AS (SELECT id, regexp_extract(id, '^(.*)\\.\\d+$', 1) AS page_id FROM i)
      SELECT page_id, id FROM p WHERE page_id <> '' AND page_id NOT IN (SELECT page_id FROM p WHERE suffix(id, '.3'))""",
    "q_all_or_nothing": f"""WITH i AS (SELECT DISTINCT {_CANON} AS id FROM papers), p AS (SELECT id, regexp_extract(id, '^(.*)\\.\\d+$', 1) AS page_id FROM i)
      SELECT page_id, CAST(CASE WHEN bool_or(suffix(id, '.3')) THEN 0 ELSE count(*) END AS INT) AS n_ids FROM p WHERE page_id <> '' GROUP BY 1""",
    "q_extract_success_ratio": f"SELECT year, count(*) AS n_found, count(nullif(trim(pdf_url), '')) AS n_ok FROM ({_PAGE}) GROUP BY 1",
    "q_fetch_join": f"""WITH s AS (SELECT url FROM papers WHERE url IS NOT NULL UNION SELECT url FROM ({_SEED}))
      SELECT url, url IN (SELECT url FROM papers WHERE url IS NOT NULL AND year >= 2000) AS fetched FROM s""",
    "q_visited_first": f"""SELECT job_id, string_split(url, '#')[1] AS base, CAST(min(seed_no) AS INT) AS seed_no FROM ({_SEED}) GROUP BY 1, 2""",
    "q_union_seeds": f"""SELECT job_id, CAST(seed_no AS INT) AS seed_no, url AS seed FROM ({_SEED})
      UNION ALL SELECT _id, CAST(coalesce(len(urls), 0) AS INT), '{BASE}/search/?q=' || replace(query, ' ', '+')
      FROM (SELECT DISTINCT ON (_id) * FROM crawler_jobs) WHERE query <> ''""",
    "q_slice_before_filter": """WITH o AS (SELECT DISTINCT _id, job_id, pdf_url FROM papers WHERE job_id IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY _id) AS n FROM o)
      SELECT job_id, _id FROM r WHERE n <= 5 AND suffix(pdf_url, '.pdf')""",
    "q_budget_fold": f"""WITH RECURSIVE o AS (SELECT DISTINCT _id, job_id, {_CANON} AS id, coalesce(suffix(pdf_url, '.pdf'), false) AS ok FROM papers),
      c AS (SELECT job_id, id, min(_id) AS place, bool_or(ok) AS ok FROM o WHERE id <> '' GROUP BY 1, 2),
      j AS (SELECT DISTINCT _id AS job_id, max_papers FROM crawler_jobs),
      s AS (SELECT job_id, regexp_extract(id, '^(.*)\\.\\d+$', 1) AS seed, list({{'id': id, 'ok': ok}} ORDER BY place) AS cs FROM c GROUP BY 1, 2),
      n AS (SELECT s.*, j.max_papers, row_number() OVER (PARTITION BY s.job_id ORDER BY seed) AS pos FROM s JOIN j USING (job_id)),
      f AS (
        SELECT job_id, max_papers, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS found FROM (SELECT DISTINCT job_id, max_papers FROM n)
        UNION ALL
        SELECT f.job_id, f.max_papers, n.pos, list_concat(f.found, list_transform(list_filter(
          CASE WHEN f.max_papers IS NULL THEN n.cs ELSE n.cs[1:greatest(f.max_papers - len(f.found), 0)] END, lambda x: x.ok), lambda x: x.id))
        FROM f JOIN n ON n.job_id = f.job_id AND n.pos = f.pos + 1
      )
      SELECT job_id, unnest(found) AS id FROM (SELECT job_id, arg_max(found, pos) AS found FROM f GROUP BY 1)""",
}
