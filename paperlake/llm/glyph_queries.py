"""Queries p7_...: one form of writing for titles, authors and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.glyphs import TO, normalise
from paperlake.session import table


def field_values(spark: SparkSession, data: str) -> DataFrame:
    """(paper_id, field_name, value) of all titles, author names and contents, in one scan."""
    one = lambda name, value: F.struct(F.lit(name).alias("field_name"), value.alias("value"))
    papers = table(spark, data, "papers")
    nothing = F.array().cast("array<struct<field_name:string,value:string>>")
    values = F.concat(
        F.array(one("title", F.col("title"))),
        F.coalesce(F.transform("authors", lambda a: one("authors", a)), nothing),
        F.coalesce(
            F.transform(
                F.map_entries("sections"),
                lambda e: F.struct(e["key"].alias("field_name"), e["value"]["content"].alias("value")),
            ),
            nothing,
        ),
    )
    return papers.select(F.col("_id").alias("paper_id"), F.explode(values).alias("v")).select("paper_id", "v.field_name", "v.value")


def p7_found(spark: SparkSession, data: str) -> DataFrame:
    return normalise(field_values(spark, data), keep=("paper_id", "field_name")).select("paper_id", "field_name").distinct()


def p7_normal_values(spark: SparkSession, data: str) -> DataFrame:
    """The changed values themselves."""
    return normalise(field_values(spark, data), keep=("paper_id", "field_name")).distinct()


QUERIES = {"p7_found": p7_found, "p7_normal_values": p7_normal_values}
# The repairs with one reading, and words of mixed scripts of whose readings the vocabulary has one, or all its pieces.
_EAST = r"\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_LATIN, _CYRILLIC, _GREEK = r"A-Za-z\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{1d00}-\x{1dbf}\x{1e00}-\x{1eff}", r"\x{400}-\x{52f}\x{1c80}-\x{1c8f}", r"\x{370}-\x{3ff}\x{1f00}-\x{1fff}"
_ANY = _LATIN + _CYRILLIC + _GREEK + r"\x{300}-\x{36f}"
_MIXED = "|".join(f"[{x}][{_ANY}]*[{y}]" for x in (_LATIN, _CYRILLIC, _GREEK) for y in (_LATIN, _CYRILLIC, _GREEK) if x != y)



def _translated(table: dict[str, str]) -> str:
    return f"translate(w, '{''.join(table)}', '{''.join(table.values())}')"


SQL = {
    "p7_found": rf"""
WITH v AS (
  SELECT _id, 'title' AS field_name, title AS value FROM papers UNION ALL
  SELECT _id, 'authors', unnest(authors) FROM papers UNION ALL
  SELECT _id, e.key, e.value.content FROM (SELECT _id, unnest(map_entries(sections)) AS e FROM papers)
), u AS (
  SELECT _id, field_name, nfc_normalize(value) AS n, value, regexp_matches(value, '[{_EAST}]') AS east FROM v WHERE regexp_matches(value, '[^\x00-\x7f]')
), k AS (
  SELECT *, regexp_replace(CASE WHEN east THEN regexp_replace(n, '(^|\n|[\x{{3001}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ff01}}-\x{{ff1f}}])\x{{3000}}+', '\1', 'g') ELSE n END,
           '\x{{94d}}[\x{{200c}}\x{{200d}}]+', '', 'g') AS x FROM u
), words AS (
  SELECT DISTINCT unnest(regexp_extract_all(nfc_normalize(value), '[{_ANY}]+')) AS w FROM v
), vocabulary AS (
  SELECT DISTINCT lower(w) AS w FROM words WHERE NOT regexp_matches(w, '{_MIXED}')
), vocabulary_pieces AS (
  SELECT DISTINCT substr(w, i, 3) AS piece FROM (SELECT '^' || w || '$' AS w, unnest(range(1, length(w) + 1)) AS i FROM vocabulary)
), readings AS (
  SELECT w, lower(unnest([{_translated(TO["L"])}, {_translated(TO["C"])}, {_translated(TO["G"])}])) AS r FROM words WHERE regexp_matches(w, '{_MIXED}')
), reading_pieces AS (
  SELECT w, r, substr('^' || r || '$', i, 3) AS piece FROM (SELECT w, r, unnest(range(1, length(r) + 1)) AS i FROM readings WHERE length(r) >= 4)
), known AS (
  SELECT w FROM readings SEMI JOIN vocabulary ON readings.r = vocabulary.w WHERE NOT regexp_matches(r, '{_MIXED}') UNION
  SELECT w FROM reading_pieces p LEFT JOIN vocabulary_pieces q USING (piece) WHERE NOT regexp_matches(r, '{_MIXED}')
  GROUP BY w, r HAVING count(q.piece) = count(*)
), mixed AS (
  SELECT _id, field_name, unnest(regexp_extract_all(n, '[{_ANY}]+')) AS w FROM u WHERE regexp_matches(n, '{_MIXED}')
)
SELECT DISTINCT _id AS paper_id, field_name FROM k
WHERE n <> value
   OR regexp_matches(x, '[\x{{ad}}\x{{180e}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{2064}}\x{{feff}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]')
   OR regexp_matches(x, '[\x{{2010}}\x{{2011}}\x{{2043}}\x{{fe63}}\x{{ff0d}}\x{{fb00}}-\x{{fb06}}\x{{ff10}}-\x{{ff19}}\x{{ff21}}-\x{{ff3a}}\x{{ff41}}-\x{{ff5a}}\x{{1d400}}-\x{{1d7ff}}\x{{ff61}}-\x{{ff9f}}]')
   OR NOT east AND regexp_matches(x, '[\x{{ff01}}-\x{{ff0f}}\x{{ff1a}}-\x{{ff20}}\x{{ff3b}}-\x{{ff40}}\x{{ff5b}}-\x{{ff60}}\x{{ffe0}}-\x{{ffe6}}]')
UNION SELECT _id, field_name FROM mixed SEMI JOIN known USING (w)""",
}
