"""Queries p2_...: one record per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.survivors import canonical_source_id, consensus_values, is_pdf_address, survivors
from paperlake.session import table


def _papers(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "papers").withColumn("group_key", canonical_source_id(F.col("source_id")))


def _characters() -> F.Column:
    lengths = F.transform(F.map_values("sections"), lambda s: F.coalesce(F.length(s["content"]), F.lit(0)))
    return F.coalesce(F.aggregate(lengths, F.lit(0), lambda a, n: a + n), F.lit(0))


def _all_text() -> F.Column:
    return F.array_join(
        F.transform(F.array_sort(F.map_keys("sections")), lambda k: F.concat(k, F.lit("\n"), F.coalesce(F.col("sections")[k]["content"], F.lit("")))),
        "\n\n",
    )


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    characters = _characters()
    return (
        survivors(
            _papers(spark, data),
            {
                "pdf_url": (F.col("pdf_url"), is_pdf_address(F.col("pdf_url")), (F.col("updated_at"),)),
                "sections": (_all_text(), characters > 0, (characters, F.col("updated_at"))),
            },
        )
        .select("group_id", "field_name", F.col("record_id").alias("paper_id"))
        .distinct()
    )


def p2_titles(spark: SparkSession, data: str) -> DataFrame:
    """The title that the records of each paper agree on, every record having one vote."""
    papers = _papers(spark, data).where(F.col("group_key").isNotNull()).select("_id", "group_key", "title").distinct()
    ids = papers.groupBy("group_key").agg(F.min("_id").alias("group_id"), F.count_distinct("_id").alias("n")).where(F.col("n") > 1)
    votes = papers.join(ids, "group_key").select(F.col("group_id").alias("group"), F.col("title").alias("value"), F.lit(1.0).alias("weight"))
    return consensus_values(votes).select(F.col("group").alias("group_id"), F.col("value").alias("title"))


def p2_clear_titles(spark: SparkSession, data: str) -> DataFrame:
    """The titles of p2_titles where more than half of a paper's records with a title have one title."""
    papers = _papers(spark, data).where(F.col("group_key").isNotNull() & F.col("title").isNotNull()).select("_id", "group_key", "title").distinct()
    most = papers.groupBy("group_key", "title").agg(F.count(F.lit(1)).alias("k"))
    total = papers.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    clear = most.join(total, "group_key").where(2 * F.col("k") > F.col("n")).select("group_key")
    ids = _papers(spark, data).groupBy("group_key").agg(F.min("_id").alias("group_id"))
    return p2_titles(spark, data).join(clear.join(ids, "group_key").select("group_id"), "group_id", "left_semi")


QUERIES = {"p2_found": p2_found, "p2_titles": p2_titles, "p2_clear_titles": p2_clear_titles}

# Ties of rank with different values, which the operator settles by consensus, don't occur in this data.
SQL = {
    "p2_found": """
WITH p AS (
  SELECT DISTINCT _id, updated_at, pdf_url,
         CAST(list_sum(list_transform(map_values(sections), lambda s: coalesce(length(s.content), 0))) AS BIGINT) AS chars,
         nullif(replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(lower(source_id), '\\s+', '', 'g'), '[/?#]+$', ''),
           '([^/]*)$', 1), '\\.pdf$', ''), '_', '-'), '') AS k
  FROM papers
), g AS (
  SELECT k, min(_id) AS group_id FROM p WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT _id) > 1
), u AS (
  SELECT group_id, 'pdf_url' AS field_name, _id AS paper_id,
         row_number() OVER (PARTITION BY group_id ORDER BY updated_at DESC NULLS LAST, _id) AS rn
  FROM p JOIN g USING (k) WHERE regexp_matches(pdf_url, '^(?i)https?://[^\\s/?#]+\\.[^\\s/?#]+/[^\\s?#]*[^\\s/?#]\\.pdf$')
  UNION ALL
  SELECT group_id, 'sections', _id,
         row_number() OVER (PARTITION BY group_id ORDER BY chars DESC, updated_at DESC NULLS LAST, _id)
  FROM p JOIN g USING (k) WHERE chars > 0
)
SELECT group_id, field_name, paper_id FROM u WHERE rn = 1""",
    "p2_clear_titles": """
WITH p AS (
  SELECT DISTINCT _id, title,
         nullif(replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(lower(source_id), '\\s+', '', 'g'), '[/?#]+$', ''),
           '([^/]*)$', 1), '\\.pdf$', ''), '_', '-'), '') AS k
  FROM papers
), g AS (
  SELECT k, min(_id) AS group_id FROM p WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT _id) > 1
), v AS (
  SELECT group_id, title, count(*) AS n, sum(count(*)) OVER (PARTITION BY group_id) AS total
  FROM p JOIN g USING (k) WHERE title IS NOT NULL GROUP BY group_id, title
)
SELECT group_id, title FROM v WHERE 2 * n > total""",
}
