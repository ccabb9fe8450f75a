"""Queries p9_...: evaluation items in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.inputs import documents
from paperlake.llm.leaks import leaks
from paperlake.session import table


def p9_found(spark: SparkSession, data: str) -> DataFrame:
    return leaks(documents(spark, data), table(spark, data, "eval_items"))


def p9_leaked_items(spark: SparkSession, data: str) -> DataFrame:
    """Per evaluation item, the number of documents it leaked into; items that leaked nowhere have none."""
    items = table(spark, data, "eval_items")
    count = p9_found(spark, data).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "task", "lang").distinct().join(count, "item_id", "left").na.fill(0, ["n_docs"])


QUERIES = {"p9_found": p9_found, "p9_leaked_items": p9_leaked_items}
_LEAKS = r"""
WITH t AS (
  SELECT 'doc' AS side, doc_id AS id, text FROM documents WHERE text <> '' UNION ALL
  SELECT 'item', item_id, text FROM eval_items WHERE text <> ''
), w AS (
  SELECT DISTINCT side, id, list_filter(string_split(regexp_replace(regexp_replace(lower(nfc_normalize(text)),
           '[\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words,
         length(regexp_replace(text, '[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]', '', 'g')) * 3 > length(text) AS east
  FROM t
), s AS (
  SELECT side, id, east, words, array_to_string(words, '') AS chars FROM w
), items AS (
  SELECT id, east, CASE WHEN east THEN string_split(chars, '') ELSE words END AS parts FROM s WHERE side = 'item' AND len(words) > 0
), item_sizes AS (
  SELECT *, CASE WHEN east THEN least(40, len(parts)) ELSE least(12, len(parts)) END AS n FROM items
), sizes AS (SELECT DISTINCT east, n FROM item_sizes
), texts AS (
  SELECT 'item' AS side, id, east, parts FROM item_sizes UNION ALL
  SELECT 'doc', id, false, words FROM s WHERE side = 'doc' UNION ALL
  SELECT 'doc', id, true, string_split(chars, '') FROM s WHERE side = 'doc' AND regexp_matches(chars, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')
), tokens AS (
  SELECT side, id, east, unnest(parts) AS token, generate_subscripts(parts, 1) AS place FROM texts
), runs AS (
  SELECT side, id, east, list(token) OVER (PARTITION BY side, id, east ORDER BY place ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS run FROM tokens
), item_windows AS (
  SELECT DISTINCT r.id, r.east, n, array_to_string(run[1:n], ' ') AS passage FROM runs r JOIN item_sizes z ON z.id = r.id AND side = 'item' WHERE len(run) >= n
), doc_windows AS (
  SELECT id, r.east, n, array_to_string(run[1:n], ' ') AS passage FROM runs r JOIN sizes z ON r.east = z.east AND side = 'doc' WHERE len(run) >= n
), found AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM doc_windows d JOIN item_windows i USING (east, n, passage)
)
"""

SQL = {
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p9_leaked_items": _LEAKS
    + """SELECT e.item_id, e.task, e.lang, coalesce(n, 0) AS n_docs FROM (SELECT DISTINCT item_id, task, lang FROM eval_items) e
         LEFT JOIN (SELECT item_id, count(*) AS n FROM found GROUP BY item_id) f USING (item_id)""",
}
