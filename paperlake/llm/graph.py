"""Connected components by repeated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

MOST_ROUNDS = 60


def _settled(df: DataFrame) -> DataFrame:
    """`df` written, without the size that the planner estimated for it.

    A checkpoint keeps that estimate, and a join's is the product of its sides.
    Carried from round to round, the number gets several times as many digits
    each time, until planning takes all of the driver's time and memory.
    """
    spark, written = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node of its part.

    Each round a node takes the smallest label among its neighbours, and the
    label of that label, which halves distances; labels are pre-aggregated per
    node before the shuffle, so a node with very many edges is no single task.
    Rounds end when no label changes.  Loops and repeated edges do no harm; an
    empty table gives no rows.
    """
    both = _settled(
        edges.select("a", "b")
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .distinct()
    )
    labels = _settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(MOST_ROUNDS):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = _settled(
            stepped.join(jump, "next", "left").select(
                "node", F.col("component").alias("old"), F.least("next", F.coalesce("far", "next")).alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError("components did not settle")
