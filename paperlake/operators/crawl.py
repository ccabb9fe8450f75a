"""Crawl planning: what each job fetches, in which order, within its budget.

A job has seeds in order; a seed has candidates in order.  Of each seed as many
candidates are tried as papers are still wanted; addresses seen before, even in
vain, are not tried again but use up their place; failures are dropped and not
made up for within the seed; what a later seed may still fetch follows from
what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE = "struct<id: string, ok: boolean>"
SEED = f"struct<page: string, candidates: array<{CANDIDATE}>>"


def budget_fold(seeds: Column, max_papers: Column) -> Column:
    """Ids found by a job, in order: array<string> from array<SEED> and an optional budget.

    A seed whose page (null: it has none) was fetched before yields nothing.  A
    budget of 0 finds nothing; null means no limit.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("found"), nothing.alias("visited"))

    def step(state: Column, seed: Column) -> Column:
        # greatest() passes over nulls, so a missing budget is kept apart.
        left = F.when(max_papers.isNotNull(), F.greatest(max_papers - F.size(state["found"]), F.lit(0)))
        tried = F.when(max_papers.isNull(), seed["candidates"]).otherwise(F.slice(seed["candidates"], F.lit(1), left))
        stopped = F.coalesce(left == 0, F.lit(False)) | F.coalesce(F.array_contains(state["visited"], seed["page"]), F.lit(False))
        page = F.when(seed["page"].isNotNull(), F.array(seed["page"])).otherwise(nothing)
        visited = F.array_union(state["visited"], page)
        fresh = F.filter(F.array_distinct(tried), lambda c: ~F.array_contains(visited, c["id"]))
        found = F.transform(F.filter(fresh, lambda c: c["ok"]), lambda c: c["id"])
        return F.when(stopped, state).otherwise(
            F.struct(
                F.concat(state["found"], found).alias("found"),
                F.array_union(visited, F.transform(tried, lambda c: c["id"])).alias("visited"),
            )
        )

    return F.aggregate(seeds, start, step, lambda s: s["found"])


def first_visits(visits: DataFrame, *keys: str, order: tuple[str, ...]) -> DataFrame:
    """The first visit of every address within the keys, by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return visits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def slice_then_filter(candidates: DataFrame, seed: str, order: tuple[str, ...], n: int, keep: Column) -> DataFrame:
    """The first n candidates of each seed, and of those the ones that `keep`; not the first n that do."""
    w = Window.partitionBy(seed).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= n) & keep).drop("_n")


def plan(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, id) of everything the jobs find.

    `candidates` has job_id, seed_no, page, place, id, ok; `jobs` has job_id and
    max_papers.  A job without a budget needs no fold: what it finds are the
    first visits that succeed, which is one window.  With a budget of m no seed
    tries more than m candidates, so no more are gathered per seed.  A job that
    is not in `jobs` finds nothing.
    """
    j = jobs.select("job_id", "max_papers").dropDuplicates(["job_id"])
    c = candidates.join(j, "job_id")
    free = first_visits(c.where(F.col("max_papers").isNull()), "job_id", "id", order=("seed_no", "place"))
    # Only the first seed with a page reads it.
    pages = first_visits(
        c.where(F.col("max_papers").isNull() & F.col("page").isNotNull()).select("job_id", "page", "seed_no").distinct(),
        "job_id",
        "page",
        order=("seed_no",),
    ).withColumn("reads", F.lit(True))
    free = free.join(pages, ["job_id", "page", "seed_no"], "left").where(
        F.col("ok") & (F.col("page").isNull() | F.col("reads"))
    )
    w = Window.partitionBy("job_id", "seed_no").orderBy("place")
    bound = c.where(F.col("max_papers") > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("max_papers"))
    seeds = bound.groupBy("job_id", "max_papers", "seed_no", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "ok"))), lambda x: F.struct(x["id"].alias("id"), x["ok"].alias("ok"))).alias("candidates")
    )
    folded = seeds.groupBy("job_id", "max_papers").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seed_no", "page", "candidates"))), lambda s: F.struct(s["page"].alias("page"), s["candidates"].alias("candidates"))).alias("seeds")
    )
    found = folded.select("job_id", F.explode(budget_fold(F.col("seeds"), F.col("max_papers"))).alias("id"))
    return free.select("job_id", "id").unionByName(found)
