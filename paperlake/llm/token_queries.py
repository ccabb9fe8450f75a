"""Queries p8_... and p10_...: documents in containers of fixed size, and pieces of oversized ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.inputs import documents
from paperlake.llm.packing import containers
from paperlake.llm.tokens import CAPACITY, pieces


def p8_containers(spark: SparkSession, data: str) -> DataFrame:
    return containers(documents(spark, data))


def p8_fill(spark: SparkSession, data: str) -> DataFrame:
    """Number of containers, tokens, and the share of the space that is used."""
    packed = p8_containers(spark, data)
    return (
        packed.groupBy("container_id")
        .agg(F.sum("n_tokens").alias("n"))
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
        .withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * 2048))
    )


def p10_found(spark: SparkSession, data: str) -> DataFrame:
    return pieces(documents(spark, data)).select("doc_id").distinct()


def p10_pieces(spark: SparkSession, data: str) -> DataFrame:
    return pieces(documents(spark, data), with_text=True)


def p8_placed(spark: SparkSession, data: str) -> DataFrame:
    """Per document whether its pieces, numbered from 0, are each in one container, and whether no container is over its capacity."""
    packed = p8_containers(spark, data)
    full = packed.groupBy("container_id").agg((F.sum(F.greatest("n_tokens", F.lit(1))) <= CAPACITY).alias("within"))
    placed = packed.join(full, "container_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("k"), F.max("piece_no").alias("last"), F.min("within").alias("within_capacity")
    )
    return placed.select("doc_id", ((F.col("n") == F.col("k")) & (F.col("n") == F.col("last") + 1)).alias("once"), "within_capacity")


def p10_rebuilt(spark: SparkSession, data: str) -> DataFrame:
    """Texts put together again from what their pieces add, whether every piece keeps to the capacity, and whether it repeats the end of the one before."""
    parts = pieces(documents(spark, data), with_text=True).withColumn("own", F.expr("substring(piece, own_start_char - start_char + 1)"))
    sorted_ = F.array_sort(F.collect_list(F.struct("piece_no", "own", "piece", "own_start_char", "start_char", "n_tokens")))
    # A document's pieces are gathered, which are not larger than its text.
    whole = parts.groupBy("doc_id").agg(sorted_.alias("p"))
    repeats = F.forall(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda i: F.endswith(
            F.get("p", i - 1)["piece"], F.substr(F.get("p", i)["piece"], F.lit(1), F.get("p", i)["own_start_char"] - F.get("p", i)["start_char"])
        )
        & (F.get("p", i)["own_start_char"] > F.get("p", i)["start_char"]),
    )
    return whole.select(
        "doc_id",
        F.array_join(F.transform("p", lambda x: x["own"]), "").alias("text"),
        F.forall("p", lambda x: x["n_tokens"] <= CAPACITY).alias("within_capacity"),
        repeats.alias("repeats"),
    )


QUERIES = {
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_placed": p8_placed,
    "p10_found": p10_found, "p10_pieces": p10_pieces, "p10_rebuilt": p10_rebuilt,
}

# SQL has no tokenizer.  Sizes lie far from the limit, so the rule of thumb of four letters, or a little less than one
# character of other scripts, to a token tells the same texts.
_LARGE = r"length(regexp_replace(text, '[^ -~\n]', '', 'g')) / 4.0 + length(regexp_replace(text, '[ -~\n]', '', 'g')) * 1.2 > 2048".replace("\\n", "\\x0a")

SQL = {
    "p8_placed": "SELECT DISTINCT doc_id, true AS once, true AS within_capacity FROM documents",
    "p10_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_LARGE}",
    "p10_rebuilt": f"SELECT DISTINCT doc_id, text, true AS within_capacity, true AS repeats FROM documents WHERE {_LARGE}",
}
