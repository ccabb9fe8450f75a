"""Queries p5_...: which contents are natural prose, and the measures behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm.inputs import sections
from paperlake.llm.quality import quality, unnatural


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    return unnatural(sections(spark, data)).select("paper_id", "section_key").distinct()


def p5_statistics(spark: SparkSession, data: str) -> DataFrame:
    return quality(sections(spark, data)).distinct()


def p5_measures(spark: SparkSession, data: str) -> DataFrame:
    """The measures that plain SQL can state."""
    columns = ("paper_id", "section_key", "n_chars", "n_words", "n_lines", "digit_ratio", "mean_word_length", "duplicate_line_share")
    return quality(sections(spark, data)).select(*columns).distinct()


QUERIES = {"p5_found": p5_found, "p5_statistics": p5_statistics, "p5_measures": p5_measures}

_WORD = (
    r"[^\s\p{Nd}_!-/:-@\[-`{-~\x{1c}-\x{1f}\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}\x{964}\x{965}\x{1680}\x{2000}-\x{2bff}"
    r"\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{30fb}\x{ff01}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}]+"
)

SQL = {
    "p5_measures": f"""
WITH c AS (
  SELECT DISTINCT _id AS paper_id, e.key AS section_key, e.value.content AS t
  FROM (SELECT _id, unnest(map_entries(sections)) AS e FROM papers) WHERE e.value.content <> ''
), m AS (
  SELECT paper_id, section_key, t, regexp_extract_all(lower(t), '{_WORD}') AS words,
         list_filter(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]', '', 'g')) <> '') AS lines,
         length(t) - length(regexp_replace(t, '[ \\t\\n]', '', 'g')) AS spaces, length(regexp_replace(t, '\\P{{Nd}}', '', 'g')) AS digits
  FROM c
)
SELECT paper_id, section_key, CAST(length(t) AS INT) AS n_chars, CAST(len(words) AS INT) AS n_words, CAST(len(lines) AS INT) AS n_lines,
       digits / CASE WHEN length(t) = spaces THEN 1 ELSE length(t) - spaces END AS digit_ratio,
       CASE WHEN len(words) = 0 THEN 0.0 ELSE CAST(list_sum(list_transform(words, lambda w: length(w))) AS DOUBLE) / len(words) END AS mean_word_length,
       CASE WHEN len(lines) < 2 THEN 0.0
            ELSE 1 - CAST(list_sum(list_transform(list_distinct(lines), lambda x: length(x))) AS DOUBLE)
                     / CAST(list_sum(list_transform(lines, lambda x: length(x))) AS DOUBLE) END AS duplicate_line_share
FROM m""",
}
