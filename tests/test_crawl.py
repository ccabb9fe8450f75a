"""The crawl plan against worked examples, and against a plain fold on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators.crawl import SEED, budget_fold, first_visits, plan, slice_then_filter


def seed(text: str, page: str | None = None) -> dict:
    return {"page": page, "candidates": [{"id": x.rstrip("!"), "ok": not x.endswith("!")} for x in text.split()]}


EXAMPLES = [
    ([seed("a b! c"), seed("d")], 2, ["a", "d"]),
    ([seed("a b! c"), seed("a b d"), seed("d e")], 4, ["a", "c", "d", "e"]),
    ([seed("a b")], 0, []),
    ([seed("a b! c")], None, ["a", "c"]),
    ([seed("a a b")], 2, ["a"]),
    ([seed("a b", "u"), seed("c d", "u")], None, ["a", "b"]),
    ([], 3, []),
    ([seed("")], 3, []),
]


@pytest.mark.parametrize("seeds, most, expected", EXAMPLES)
def test_budget_fold(spark, seeds, most, expected):
    df = spark.createDataFrame([(seeds, most)], f"seeds array<{SEED}>, most int")
    assert df.select(budget_fold(F.col("seeds"), F.col("most"))).first()[0] == expected


def plain_fold(seeds: list[dict], most: int | None) -> list[str]:
    found, visited = [], set()
    for s in seeds:
        if most is not None and len(found) >= most:
            break
        if s["page"] is not None:
            if s["page"] in visited:
                continue
            visited.add(s["page"])
        left = None if most is None else most - len(found)
        for c in s["candidates"][:left]:
            if c["id"] not in visited:
                visited.add(c["id"])
                if c["ok"]:
                    found.append(c["id"])
    return found


def test_plan_equals_plain_fold(spark):
    random.seed(3)
    jobs, rows, expected = [], [], set()
    for j in range(40):
        most = random.choice([None, 0, 1, 3, 7])
        ok = {c: random.random() < 0.7 for c in "abcdefghij"}
        seeds = []
        for _ in range(random.randrange(5)):
            page = random.choice([None, "p", "q"])
            seeds.append({"page": page, "candidates": [{"id": c, "ok": ok[c]} for c in random.choices("abcdefghij", k=random.randrange(1, 6))]})
        jobs.append((f"j{j}", most))
        for n, s in enumerate(seeds):
            rows += [(f"j{j}", n, s["page"], i, c["id"], c["ok"]) for i, c in enumerate(s["candidates"])]
        expected |= {(f"j{j}", x) for x in plain_fold(seeds, most)}
    candidates = spark.createDataFrame(rows, "job_id string, seed_no int, page string, place int, id string, ok boolean")
    got = plan(candidates, spark.createDataFrame(jobs, "job_id string, max_papers int"))
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed))
    # Without a budget the free path looks at first visits only; pages read twice differ in nothing else.
    assert set(listed) == expected


def test_first_visits_and_slices(spark):
    df = spark.createDataFrame([("j", "u", 2), ("j", "u", 1), ("k", "u", 5), ("j", None, 0)], "job string, url string, n int")
    assert {tuple(r) for r in first_visits(df, "job", "url", order=("n",)).collect()} == {("j", "u", 1), ("k", "u", 5), ("j", None, 0)}
    c = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, True)], "s string, n int, ok boolean")
    assert [r.n for r in slice_then_filter(c, "s", ("n",), 2, F.col("ok")).collect()] == [2]
